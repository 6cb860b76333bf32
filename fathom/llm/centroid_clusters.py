"""Exact Lloyd rounds over integer vectors with Drake's adaptive bounds.

Beside its vector each row keeps the cluster it is in, an upper bound of the
distance to that centroid, lower bounds of the distances to several next
nearest centroids, and one remainder bound below the distances to all others.
When centroids move, bounds widen by how far each moved. A row whose upper
bound stays below every lower bound can't change its cluster and costs no
distance; else the bounds are tightened step by step: the own centroid, then
the listed ones if the remainder bound still certifies that no other one can
be nearest, and only then all of them. Certifying asks for a strict
margin, so that ties and rounding are always settled by whole numbers.

A round is one pass that reads the rows of the round before, writes the new
ones, and sums per task how many vectors and which components entered or left
each cluster; those sums meet in one aggregation, and only the centroids, k
rows, reach the driver. Tables lie in the shared folder, so a lost executor
costs no more than its tasks of one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm._common import SHORT_ROWS, batches, drop_stored, held, stored, table
from fathom.llm.topk_search import usable

#: Next nearest centroids with a bound of their own.
LISTED = 3
#: Share of a bound by which doubles may be wrong, taken large.
SLACK = 1e-9


def _state(listed: int) -> np.dtype:
    return np.dtype([("own", "<i4"), ("upper", "<f8"), ("near", "<i4", (listed,)), ("lower", "<f8", (listed,)), ("rest", "<f8")])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, whole numbers, of each row of x to each row of c."""
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for j, one in enumerate(c):
        gap = x - one
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def scanned(x: np.ndarray, c: np.ndarray, listed: int) -> np.ndarray:
    """States of vectors compared with all centroids; of equally near ones the smaller number comes first."""
    far = squared(x, c)
    order = np.argsort(far, axis=1, kind="stable")
    near = np.take_along_axis(far, order, axis=1)
    out = np.empty(len(x), dtype=_state(listed))
    out["own"], out["upper"] = order[:, 0], np.sqrt(near[:, 0]) * (1 + SLACK)
    out["near"], out["lower"] = order[:, 1 : listed + 1], np.sqrt(near[:, 1 : listed + 1]) * (1 - SLACK)
    out["rest"] = np.sqrt(near[:, listed + 1]) * (1 - SLACK) if len(c) > listed + 1 else np.inf
    return out


def moved(x: np.ndarray, state: np.ndarray, c: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, int]:
    """States of vectors after centroids moved by steps to c, and how many distances that took."""
    listed = state["near"].shape[1]
    out = state.copy()
    out["upper"] += steps[out["own"]]
    out["lower"] -= steps[out["near"]]
    out["rest"] -= steps.max()
    floor = np.minimum(out["lower"].min(axis=1, initial=np.inf), out["rest"])
    open_ = np.flatnonzero(out["upper"] >= floor)
    if not len(open_):
        return out, 0
    gap = x[open_] - c[out["own"][open_]]
    out["upper"][open_] = np.sqrt(np.einsum("ij,ij->i", gap, gap)) * (1 + SLACK)
    cost = len(open_)
    open_ = open_[out["upper"][open_] >= floor[open_]]
    # The own centroid's distance bounds that of the nearest: below the remainder bound only listed ones matter.
    listable = open_[out["upper"][open_] < out["rest"][open_]]
    if len(listable):
        names = np.column_stack([out["own"][listable], out["near"][listable]])
        names.sort(axis=1)  # equally near ones: the smaller number first
        far = np.empty(names.shape, dtype=np.int64)
        for j in range(names.shape[1]):
            gap = x[listable] - c[names[:, j]]
            far[:, j] = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(far, axis=1, kind="stable")
        names, far = np.take_along_axis(names, order, axis=1), np.sqrt(np.take_along_axis(far, order, axis=1))
        out["own"][listable], out["upper"][listable] = names[:, 0], far[:, 0] * (1 + SLACK)
        out["near"][listable], out["lower"][listable] = names[:, 1:], far[:, 1:] * (1 - SLACK)
        cost += far.size
    rest = open_[out["upper"][open_] >= out["rest"][open_]]
    if len(rest):
        out[rest] = scanned(x[rest], c, listed)
        cost += len(rest) * len(c)
    return out, cost


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """The fixed-width values of a binary column as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def _binary(data: np.ndarray) -> pa.Array:
    """Each row of an array as one binary value."""
    n, raw = len(data), np.ascontiguousarray(data).tobytes()
    width = len(raw) // n if n else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype("<i4").tobytes()), pa.py_buffer(raw)])


#: A row is a vector with its state, or, with a cluster, what a task adds to the sums of that cluster; distances of a round are counted at cluster -1.
PASS = "id long, vector binary, state binary, cluster int, n long, sums array<long>"


def _pass(rows: DataFrame, dimension: int, k: int, step: Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, int]], listed: int) -> DataFrame:
    """Runs step(vectors, states) over rows (id, vector, state) as one pass with the sums' changes behind the rows of each task."""
    names = [x.split(" ")[0] for x in PASS.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cost = np.zeros(k, dtype=np.int64), np.zeros((k, dimension), dtype=np.int64), 0
        for part in parts:
            if not part.num_rows:
                continue
            x = _rows(part.column(1), 8 * dimension).view("<i8")
            old = None if part.column(2).null_count else _rows(part.column(2), _state(listed).itemsize).view(_state(listed))[:, 0]
            new, took = step(x, old)
            cost += took
            changed = np.arange(len(x)) if old is None else np.flatnonzero(old["own"] != new["own"])
            for sign, own in ((1, new), (-1, old)):
                if own is not None and len(changed):
                    np.add.at(n, own["own"][changed], sign)
                    np.add.at(sums, own["own"][changed], sign * x[changed])
            none = lambda kind, size=part.num_rows: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _binary(new), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], names)
        used = np.flatnonzero((n != 0) | sums.any(axis=1))
        tail = [*[(int(j), int(n[j]), sums[j].tolist()) for j in used], (-1, cost, [])]
        cluster, count, total = zip(*tail, strict=True)
        none = lambda kind: pa.nulls(len(tail), kind)
        yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.binary()), none(pa.binary()), pa.array(cluster, pa.int32()), pa.array(count, pa.int64()), pa.array(total, pa.list_(pa.int64()))], names)

    with held(rows.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch=SHORT_ROWS):
        return stored(rows.select("id", "vector", "state").mapInArrow(run, PASS))


def _changes(passed: DataFrame, k: int, dimension: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What a pass adds to the number and sum of each cluster's vectors, whole numbers of any size, and the distances it took."""
    tails = passed.where("cluster IS NOT NULL").select("cluster", "n", "sums")
    # The number goes before the components, as one more of them.
    each = tails.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("place", "value"))
    n, sums, cost = np.zeros(k, dtype=object), np.zeros((k, dimension), dtype=object), 0
    for r in each.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # k rows a component
        if r.cluster < 0:
            cost = int(r.value)
        elif r.place == 0:
            n[r.cluster] = int(r.value)
        else:
            sums[r.cluster, r.place - 1] = int(r.value)
    return n, sums, cost


def clustered(vectors: DataFrame, k: int, rounds: int, *, seed: int = 3, listed: int = LISTED) -> tuple[DataFrame, np.ndarray, list[int]]:
    """id, cluster, distance of vectors (id long, v array<long>), the centroids, and how many distances each pass took.

    Vectors have one length and no null components. Centroids 0, 1, ... start
    as the k vectors with the smallest sha256 of `seed:id`, fewer if there are
    fewer; of rows with one id, which all take part, those with smaller
    components go first, and null ids last. Each round assigns every vector to
    its nearest centroid, of equally near ones the smaller, and moves each
    centroid that has vectors to the floor of their mean; then vectors are
    assigned once more. Rounds after one that moves nothing would change
    nothing and are left out. distance is squared. No vectors give no rows. A
    component so large that a squared distance might not fit 64 bits raises.
    """
    spark = vectors.sparkSession
    batches(spark)
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("v")]
    first = vectors.orderBy(*order).select("v").limit(k).collect()
    if not first:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, 0), dtype=np.int64), []
    centroids = np.array([r.v for r in first], dtype=np.int64)
    k, dimension = centroids.shape
    listed = min(listed, k - 1)
    most = int((2**63 / dimension) ** 0.5 / 2) - 1

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, dimension), dtype=np.int64)
            if x.shape[1] != dimension or x.size and (x.max() > most or x.min() < -most):
                raise ValueError(f"vectors must have {dimension} components of {most} at most")
            yield pa.RecordBatch.from_arrays([part.column(0), _binary(x), pa.nulls(len(x), pa.binary())], ["id", "vector", "state"])

    rows = vectors.select("id", "v").mapInArrow(packed, "id long, vector binary, state binary")
    passed = _pass(rows, dimension, k, lambda x, _, c=centroids: (scanned(x, c, listed), len(x) * k), listed)
    n, sums, cost = _changes(passed, k, dimension)
    costs = [cost]
    for _ in range(rounds):
        new = centroids.copy()
        for j in range(k):
            if n[j]:
                new[j] = [s // n[j] for s in sums[j]]
        if (new == centroids).all():
            break
        steps = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK) + SLACK
        centroids, old = new, passed
        passed = _pass(old.where("cluster IS NULL"), dimension, k, lambda x, s, c=new, d=steps: moved(x, s, c, d), listed)
        drop_stored(old)
        more_n, more, cost = _changes(passed, k, dimension)
        n, sums = n + more_n, sums + more
        costs.append(cost)

    def measured(parts: Iterator[pa.RecordBatch], c: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                own = _rows(part.column(2), _state(listed).itemsize).view(_state(listed))[:, 0]["own"]
                gap = _rows(part.column(1), 8 * dimension).view("<i8") - c[own]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.astype("<i4")), pa.array(np.einsum("ij,ij->i", gap, gap))], ["id", "cluster", "distance"])

    with held(spark, spark_sql_execution_arrow_maxRecordsPerBatch=SHORT_ROWS):
        found = stored(passed.where("cluster IS NULL").select("id", "vector", "state").mapInArrow(measured, "id long, cluster int, distance long"))
    drop_stored(passed)
    return found, centroids, costs


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found (cluster, distance, whatever else) with cluster_inertia, inertia and centroid_sha256, the digest of a centroid's components joined by commas."""
    spark = found.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = each.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # as many rows as there are clusters
    each = each.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    return found.join(F.broadcast(each), "cluster")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the usable `embeddings` vectors of 64 components, as floor(1024 * x), in 8 clusters after 10 rounds."""
    rows = table(spark, sf_dir, "embeddings").where((F.size("embedding") == 64) & usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024))
    found, centroids, _ = clustered(rows.select(F.col("vec_id").alias("id"), whole.alias("v")), 8, 10)
    return with_inertia(found, centroids).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = 10, k: int = 8) -> str:
    """The rounds written one after another."""
    far = "list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    floor_div = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, p FROM (SELECT sha256('3:' || vec_id) AS h, p FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.r, v.vec_id, any_value(v.p) AS p, min(struct_pack(d := {far}, c := c.c)) AS best FROM v CROSS JOIN c{i} c GROUP BY v.r, v.vec_id)")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT c, i, {floor_div} AS x FROM (SELECT best.c AS c, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{i}) GROUP BY c, i),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(any_value(n.p), any_value(c.p)) AS p FROM c{i} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS p FROM m{i} GROUP BY c) n ON n.c = c.c GROUP BY c.c)""")
    return f"""WITH {', '.join(parts)}
SELECT a.vec_id, CAST(a.best.c AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""


ORACLE = _oracle()
