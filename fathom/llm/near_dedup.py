"""MinHash near-dedup with fast similarity sketches.

A text's set holds the hashes of its distinct word shingles. Its sketch has
BINS coordinates: in each of the first BINS rounds every shingle is hashed
into a random bin, where the smallest value of the first round that reaches
the bin stays; bins that are still empty then take the smallest value of all
shingles, so that every coordinate fills. The share of equal coordinates of
two sketches is concentrated about the sets' similarity.

Texts with equal sets form a class. Classes that agree in all coordinates of
a band are candidates. To find components no bucket is expanded into pairs:
every class of a bucket is compared with the one that shares most buckets with
others. Of buckets that are not one component then, the classes outside the
largest component are compared with all others, in blocks that hold the whole
sets; buckets with the same largest component are compared together, so that
classes which share many buckets meet once. Blocks return only links that join
what they hadn't joined before. Candidates whose sketches can't belong to sets
similar enough are dropped, the rest are confirmed on the whole sets.

Sets hold 64-bit hashes and classes have 63-bit keys: among 10^11 different
sets some 540 pairs would share a key and be taken for equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm._common import batches, drop_stored, spread_join, stored, table
from fathom.llm.components import components

#: Coordinates of a sketch, and of a band. At a similarity of 0.8 a pair shares no band with a probability below 1e-7.
BINS, BAND = 128, 4
#: Equal coordinates that a pair needs to be confirmed: pairs at 0.8 have 102 on average and fewer with a probability below 1e-8.
MATCHES = 76
#: Classes on either side of a block of comparisons.
BLOCK = 256
#: Bits for each candidate, and of all at most (128 MB), of the filter that brings the sets of candidates to the executors. Beyond, more sets pass, which costs time only.
FILTER_EACH, FILTER_MOST = 32, 1 << 30

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: What is added to the shingles in each round.
_ROUNDS = _A * np.arange(1, 2 * BINS + 1, dtype=np.uint64)
_SHIFT = np.uint64(64 - (BINS.bit_length() - 1))
_STARTS = np.arange(BINS, dtype=np.uint64) << _SHIFT
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, n: int, known: Words) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; of the whole sequence if there are fewer words, of nothing if there are none."""
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    size = min(n, len(words))
    rolled = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        rolled = _mixed(rolled * _A + hashes[i : len(hashes) - size + 1 + i] + np.uint64(size))
    return np.unique(rolled)


def class_of(hashes: np.ndarray) -> int:
    """Key of a set: 63 bits of a cryptographic digest of all of it."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little") >> 1


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The BINS coordinates of a set that isn't empty, as 32-bit numbers."""
    values, empty = np.zeros(BINS, dtype=np.uint64), np.ones(BINS, dtype=bool)
    for i in range(BINS):
        # the upper bits choose the bin, the others are the value
        x = np.sort(_mixed(hashes + _ROUNDS[i]))
        at = np.searchsorted(x, _STARTS[empty])
        bins = np.flatnonzero(empty)
        found = at < len(x)
        got = x[at[found]]
        bins = bins[found]
        right = (got >> _SHIFT).astype(np.int64) == bins
        values[bins[right]] = _mixed(got[right] + np.uint64(i))
        empty[bins[right]] = False
        if not empty.any():
            break
    for b in np.flatnonzero(empty):
        x = _mixed(hashes + _ROUNDS[BINS + b]) << np.uint64(BINS.bit_length() - 1)
        values[b] = _mixed(x.min(keepdims=True) + np.uint64(BINS + b))[0]
    return (values >> np.uint64(32)).astype(np.uint32)


def _sketched(n: int, *keep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for part in parts:
            sizes, keys, sketches = [], [], []
            for text in part.column(1):
                hashes = shingles(text.as_py(), n, known)
                sizes.append(len(hashes))
                keys.append(class_of(hashes) if len(hashes) else None)
                sketches.append(sketch(hashes).view(np.int32) if len(hashes) else None)
            yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.list_(pa.int32())), *part.columns[2:]], names=["doc_id", "n", "class", "sketch", *keep])

    return rows


def _place(doc_id: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(bits))


def _wanted(ids: DataFrame) -> tuple[int, bytes]:
    """A bit for the hash of each doc_id, and how many bits. They are set in 64-bit words before they reach the driver: FILTER_MOST of them at most, whatever there is."""
    bits = max(1 << 16, min(FILTER_MOST, 1 << (FILTER_EACH * ids.count()).bit_length()))
    place = _place(F.col("doc_id"), bits)
    words = ids.select(F.floor(place / 64).cast("long").alias("word"), (place % 64).cast("int").alias("bit"))
    words = words.select("word", F.expr("shiftleft(1L, bit)").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits, out.tobytes()


def _sets(documents: DataFrame, ids: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class and the whole set, as bytes, of each class in wanted, one row each, read from documents whose id may be in ids. Texts aren't shuffled."""
    spark = documents.sparkSession
    bits, data = _wanted(ids)
    filter_bits = spark.sparkContext.broadcast(data)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = Words(), np.frombuffer(filter_bits.value, dtype=np.uint8)
        for part in parts:
            places = part.column(0).to_numpy()
            keys, sets = [], []
            for i in np.flatnonzero((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1):
                hashes = shingles(part.column(1)[int(i)].as_py(), n, known)
                if len(hashes):
                    keys.append(class_of(hashes))
                    sets.append(hashes.tobytes())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["class", "set"])

    read = documents.select(_place(F.col("doc_id"), bits).alias("place"), "text").mapInArrow(rows, "class long, set binary")
    # Rows that share a doc_id, or have none, give a class more than once.
    return read.join(wanted, "class", "left_semi").dropDuplicates(["class"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * size of the intersection >= percent * size of the union, of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(documents: DataFrame, pairs: DataFrame, representatives: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of classes whose whole sets are similar, stored."""
    batches(documents.sparkSession)
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = stored(_sets(documents, representatives.join(asked, "class"), asked, n))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = [similar(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), percent) for x, y in zip(part.column("x"), part.column("y"), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("x")), sets.select(F.col("class").alias("b"), F.col("set").alias("y"))
    out = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(rows, "a long, b long"))
    drop_stored(sets)
    return out


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) whose sizes and sketches allow them to be similar."""
    side = lambda key, tag: sketches.select(F.col("class").alias(key), F.col("n").alias(f"n_{tag}"), F.col("sketch").alias(f"s_{tag}"))
    equal = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (equal >= MATCHES)
    return pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").where(fits).select("a", "b")


def _joiner(percent: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Links between an outsider and a class of another component in one block, of those that join two components there the first found."""

    def links(key: tuple, block: pa.Table) -> pa.Table:
        outside = block["outside"].to_numpy()
        names, home, size = (block[c].to_numpy() for c in ("class", "component", "n"))
        sketches = np.array(block["sketch"].to_pylist(), dtype=np.int32).reshape(len(names), BINS)
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in block["set"]]
        inside, parent, found = np.flatnonzero(~outside), {int(c): int(c) for c in home}, []

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for i in np.flatnonzero(outside):
            at = inside[(home[inside] != home[i]) & (np.minimum(size[inside], size[i]) * 100 >= np.maximum(size[inside], size[i]) * percent)]
            equal = (sketches[at] == sketches[i]).sum(1)
            for j in at[equal >= MATCHES][np.argsort(-equal[equal >= MATCHES], kind="stable")]:
                x, y = root(int(home[i])), root(int(home[j]))
                if x != y and similar(sets[i], sets[j], percent):
                    parent[x] = y
                    found.append((int(names[i]), int(names[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return links


def _unresolved(documents: DataFrame, buckets: DataFrame, labels: DataFrame, sketches: DataFrame, representatives: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket.

    The classes outside a bucket's largest component are compared with all
    others of the buckets with that component, in blocks of both sides dealt
    by hashes.
    """
    homes = buckets.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    each = homes.groupBy("band", "component").agg(F.count("*").alias("m"))
    of_bucket = each.groupBy("band").agg(F.count("*").alias("homes"), F.max(F.struct("m", "component")).alias("top"))
    mixed = of_bucket.where("homes > 1").select("band", F.col("top.component").alias("largest"))
    rows = stored(homes.join(mixed, "band").select("largest", "class", "component").distinct())
    outer = (F.col("component") != F.col("largest")).cast("long")
    totals = rows.groupBy("largest").agg(F.count("*").alias("all"), F.sum(outer).alias("others"))
    wanted = rows.select("class").distinct()
    sets = stored(_sets(documents, representatives.join(wanted, "class"), wanted, n))
    part = lambda total, salt: F.pmod(F.xxhash64("class", F.lit(salt)), F.ceil(F.col(total) / BLOCK))
    every = lambda total: F.sequence(F.lit(0).cast("long"), (F.ceil(F.col(total) / BLOCK) - 1).cast("long"))
    dealt = rows.join(totals, "largest")
    columns = ["largest", "class", "component"]
    outside = dealt.where("component <> largest").select(*columns, F.lit(True).alias("outside"), part("others", 1).alias("p"), F.explode(every("all")).alias("q"))
    inside = dealt.select(*columns, F.lit(False).alias("outside"), part("all", 2).alias("q"), F.explode(every("others")).alias("p"))
    blocks = outside.unionByName(inside).join(sketches, "class").join(sets, "class")
    return blocks.groupBy("largest", "p", "q").applyInArrow(_joiner(percent), "a long, b long").distinct()


def _linked(documents: DataFrame, shingle: int, percent: int, *keep: str) -> DataFrame:
    """doc_id, n, class, component (a class), smallest (the component's smallest doc_id) and the long columns keep for each row of documents; without a set the last three before keep are null."""
    batches(documents.sparkSession)
    schema = ", ".join(["doc_id long, n long, class long, sketch array<int>", *(f"{c} long" for c in keep)])
    rows = stored(documents.select("doc_id", "text", *keep).mapInArrow(_sketched(shingle, *keep), schema))
    representatives = stored(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("_n")))
    band = lambda i: F.xxhash64(i, F.slice("sketch", i * BAND + 1, BAND))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BINS // BAND - 1)), band)
    placed = rows.where("class IS NOT NULL").select("class", F.explode(bands).alias("band")).distinct()
    shared = placed.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    met = stored(placed.join(shared, "band"))
    # The original of many copies is near all of them and so meets most classes; its buckets need no second look.
    weights = met.groupBy("class").agg(F.sum("m").alias("weight"))
    centres = met.join(weights, "class").groupBy("band").agg(F.max(F.struct("weight", "class")).alias("top")).select("band", F.col("top.class").alias("first"))
    buckets = stored(met.select("class", "band").join(centres, "band"))
    drop_stored(met)
    # One sketch of each class that shares a bucket, however many rows have it; the first of a partition stands for the others before they move.
    in_buckets = buckets.select("class").distinct()
    sketches = stored(rows.select("class", "n", "sketch").join(in_buckets, "class", "left_semi").dropDuplicates(["class"]))
    stars = buckets.where("class <> first").select(F.least("class", "first").alias("a"), F.greatest("class", "first").alias("b")).distinct()
    tested = stored(_likely(stars, sketches, percent))
    links = _confirmed(documents, tested, representatives, shingle, percent)
    labels = components(links)
    links = links.unionByName(stored(_unresolved(documents, buckets.select("band", "class"), labels, sketches, representatives, shingle, percent)))
    labels = components(links)
    drop_stored(buckets, sketches)
    homes = representatives.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = homes.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    found = stored(homes.join(smallest, "component").select("class", "component", "smallest", "_n"))
    named = rows.select("doc_id", "n", "class", *keep)
    without = named.where("class IS NULL").select("doc_id", "n", "class", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("smallest"), *keep)
    # A set that a third of all rows share fills no task.
    return spread_join(named.where("class IS NOT NULL"), found, ["class"], rows.count()).select(*without.columns).unionByName(without)


def grouped(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents (doc_id, text).

    Words are separated by ASCII white space and compare with A-Z lower-cased.
    Documents are linked if the similarity of their sets of word shingles is
    percent / 100 or more; component_id is the smallest doc_id reachable and
    kept tells whether it is the row's own. A null, empty or blank text has an
    empty set and is linked with nothing. Rows without doc_id take part; if a
    component has no other, its id is null and they are kept. Rows with the
    same doc_id are told apart by their sets.
    """
    rows = _linked(documents, shingle, percent)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def filtered(documents: DataFrame) -> DataFrame:
    """One row of each component of documents, and the rows without words. Columns, of any name, stay as they are.

    The row with the smallest doc_id stays, one without doc_id only if the
    component has no other; of several with that doc_id the one with the
    smallest class, then the first. Rows are numbered once and stored, so that
    they keep their numbers.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    numbered = stored(documents.select(whole, F.monotonically_increasing_id().alias("_at")))
    rows = stored(_linked(numbered.select("_row.doc_id", "_row.text", "_at"), 5, 80, "_at"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class", "_at")
    first = rows.where("class IS NOT NULL").groupBy("component").agg(F.min(order).alias("first")).select("first._at")
    kept = first.unionByName(rows.where("class IS NULL").select("_at"))
    return numbered.join(kept, "_at", "left_semi").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all of `documents`, by shingles of four words."""
    return grouped(table(spark, sf_dir, "documents"), shingle=4)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM words
), classes AS MATERIALIZED (
  SELECT min(doc_id) AS c, s, len(s) AS n, list(doc_id) AS members FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS MATERIALIZED (
  SELECT c, n, unnest(s) AS shingle FROM classes
), links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT c AS node, c AS other FROM classes
  UNION
  SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a
), homes AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
), found AS (
  SELECT unnest(k.members) AS doc_id, h.component_id FROM classes k JOIN homes h ON k.c = h.node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(f.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(f.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN found f ON s.doc_id = f.doc_id
"""
