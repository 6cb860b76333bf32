"""Line dedup: later copies of repeated line runs are deleted.

Documents are sequences of line ids, blank lines left out; every line begins a
suffix of its document. Distributed prefix doubling sorts the suffixes by
their first 1, 2, 4, ... lines: the different prefixes of a level are sorted
by ranges, and a suffix's rank is the number of suffixes with a smaller
prefix, ties being dealt out by counts, so that a line which a third of all
rows share fills no task. At each level the suffixes of one rank are an
interval of the suffix array whose longest common prefix is at least the
level's; intervals of one suffix drop out. Doubling ends when none is left, or
when a level is as long as any run that is looked up (below). So such a run is
named by the ranks of its two overlapping power-of-two blocks, and equal names
are equal runs.

A line is deleted if it lies in a run of MIN_WORDS words or more that occurs
earlier, in the order of (doc_id, line). Such runs are covered exactly by the
shortest runs of MIN_WORDS words that start or end at their lines: of a
maximal repeated run, the first such run from its start and, for each line
behind that, the one that ends there lie inside it. So only these are looked
up, two for each position; a line has a word, so they have MIN_WORDS lines at
most, however long the maximal run is.

Lines compare by their SHA-256 digests, of which no two texts are known to
share one; ranks of longer runs are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm._common import WORD, drop_stored, let, n_words, running, spread_join, stored, table

#: Runs with fewer words stay.
MIN_WORDS = 50
#: Sorts rows without doc_id behind all others.
NO_ID = 2**63 - 1

DOC = ("_d", "_h")


def _keyed(documents: DataFrame) -> DataFrame:
    """documents as a struct _row, with the key _d, _h: rows with equal doc_id and text are one document."""
    return documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"),
        F.xxhash64("text").alias("_h"),
    )


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines: Column) -> Column:
    """Places of the lines that hold a word."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD))


def _ranked(rows: DataFrame, prefix: list[str]) -> DataFrame:
    """rows (stored) whose prefix two suffixes or more share, with _rank for the prefix: the number of such suffixes that sort before. Stored."""
    # Counts are partial before the shuffle, and only different prefixes are sorted.
    shared = rows.groupBy(*prefix).agg(F.count("*").alias("_n")).where("_n > 1")
    sorted_ = running(shared, prefix, total="_n", name="_rank")
    ranks = stored(sorted_)
    out = stored(spread_join(rows, ranks, prefix, rows.count()).select(*DOC, "_s", "_rank"))
    drop_stored(sorted_, ranks)
    return out


def suffix_ranks(lines: DataFrame, longest: int) -> list[DataFrame]:
    """For each k with 2**k up to longest the suffixes (_d, _h, _s) that share their first 2**k lines with others, and their _rank among these; lines has _line, a line's digest."""
    level, levels = _ranked(lines, ["_line"]), []
    while not level.isEmpty():
        levels.append(level)
        if 2 ** len(levels) > longest:
            break
        step = 2 ** (len(levels) - 1)
        right = level.select(*DOC, (F.col("_s") - step).alias("_s"), F.col("_rank").alias("_next"))
        longer = stored(level.join(right, [*DOC, "_s"]))
        level = _ranked(longer.withColumnRenamed("_rank", "_head"), ["_head", "_next"])
        drop_stored(longer)
    return levels


def later_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs that occur earlier, as _d, _h and _ranges: arrays of first and last place among the lines with words."""
    words = F.filter(_split(F.col("_row.text")), lambda line: line.rlike(WORD))
    each = _keyed(documents).select(*DOC, F.posexplode(words).alias("_s", "_text")).select(*DOC, "_s", n_words(F.col("_text")).alias("_w"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_line"))
    lines = stored(each.dropDuplicates([*DOC, "_s"]))
    levels = suffix_ranks(lines.drop("_w"), min_words)
    spark = documents.sparkSession
    empty = "_d long, _h long, _ranges array<struct<_from:int,_to:int>>"
    if not levels:
        return spark.createDataFrame([], empty)
    named = levels[0].withColumn("_k", F.lit(0))
    for i, other in enumerate(levels[1:], 1):
        named = named.unionByName(other.withColumn("_k", F.lit(i)))

    order = Window.partitionBy(*DOC).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    ends = lines.select(*DOC, "_s", "_w", F.sum("_w").over(order).alias("_end")).withColumn("_start", F.col("_end") - F.col("_w"))
    after = Window.partitionBy(*DOC).orderBy("_start").rangeBetween(0, min_words - 1)
    before = Window.partitionBy(*DOC).orderBy("_end").rangeBetween(1 - min_words, 0)
    reach = ends.select(
        *DOC,
        "_s",
        F.max("_s").over(after).alias("_far"),
        (F.max("_end").over(after) - F.col("_start")).alias("_ahead"),
        F.min("_s").over(before).alias("_near"),
        (F.col("_end") - F.min("_start").over(before)).alias("_behind"),
    )
    forward = F.struct(F.col("_s").alias("_from"), F.col("_far").alias("_to"), F.col("_ahead").alias("_words"))
    backward = F.struct(F.col("_near").alias("_from"), F.col("_s").alias("_to"), F.col("_behind").alias("_words"))
    both = reach.select(*DOC, F.explode(F.array(forward, backward)).alias("_r")).select(*DOC, "_r.*")
    size = F.col("_to") - F.col("_from") + 1
    runs = both.where(F.col("_words") >= min_words).drop("_words").distinct().withColumn("_k", F.floor(F.log2(size.cast("double")) + 1e-9).cast("int"))
    runs = runs.where(F.col("_k") < len(levels))
    first = named.select(*DOC, "_k", F.col("_s").alias("_from"), F.col("_rank").alias("_a"))
    last = named.select(*DOC, "_k", F.col("_s").alias("_tail"), F.col("_rank").alias("_b"))
    tail = F.col("_to") + 1 - F.expr("shiftleft(1, _k)")
    runs = runs.join(first, [*DOC, "_k", "_from"]).withColumn("_tail", tail).join(last, [*DOC, "_k", "_tail"])
    runs = stored(runs.select(*DOC, "_from", "_to", size.alias("_size"), "_a", "_b"))
    drop_stored(*levels, lines)
    place, run = F.struct("_d", "_h", "_from"), ["_size", "_a", "_b"]
    earliest = stored(runs.groupBy(*run).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    later = spread_join(runs, earliest, run, runs.count()).where(place > F.col("_first"))
    return stored(_merged(later.select(*DOC, "_from", "_to")).groupBy(*DOC).agg(F.collect_list(F.struct("_from", "_to")).alias("_ranges")))


def _merged(ranges: DataFrame) -> DataFrame:
    """Ranges of places of each document without overlaps: of a text's lines two ranges each may begin and end everywhere."""
    order = Window.partitionBy(*DOC).orderBy("_from", "_to")
    reached = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("_new", F.when(F.col("_from") <= reached + 1, 0).otherwise(1))
    islands = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*DOC, "_island").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))


def deduped(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents with the later copies of repeated runs cut out of text, and n_lines and n_deleted, the lines with words before and those deleted, as _n_lines, _n_deleted.

    Lines end at newlines and are compared by their SHA-256 digests; blank
    lines are neither compared nor deleted. A null or empty text stays as it is.
    Earlier means a smaller doc_id (null last), then text hash, then line; rows
    with equal doc_id and text are one document and are treated alike, so that
    neither is a copy of the other. Other columns, of any name, stay.
    """
    ranges = later_runs(documents, min_words)
    # Merged at every size: whether the ranges could be sent to all executors would depend on how many lines repeat.
    rows = _keyed(documents).join(ranges.hint("merge"), list(DOC), "left")

    def cut(lines: Column) -> Column:
        places = F.flatten(F.transform("_ranges", lambda r: F.sequence(r["_from"], r["_to"])))
        gone = let(_filled(lines), lambda filled: F.transform(places, lambda s: F.get(filled, s)))
        left = lambda g: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g)
        return let(gone, lambda g: F.struct(F.array_join(F.transform(left(g), lambda i: F.get(lines, i)), "\n").alias("text"), F.size(g).alias("n")))

    fixed = F.when(F.col("_ranges").isNotNull(), let(_split(F.col("_row.text")), cut))
    rows = rows.select("_row", n_lines(F.col("_row.text")).alias("_n_lines"), fixed.alias("_fixed"))
    text = F.when(F.col("_fixed").isNull(), F.col("_row.text")).otherwise(F.col("_fixed.text"))
    columns = [text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in documents.columns]
    return rows.select(*columns, F.col("_n_lines"), F.coalesce("_fixed.n", F.lit(0)).cast("long").alias("_n_deleted"))


def n_lines(text: Column) -> Column:
    """Number of lines with a word; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*+")), F.lit(0)).cast("long")


def filtered(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents after line dedup, without those whose every line was a later copy; n_chars, if there is one, follows a changed text.

    Null, empty and blank texts have no lines with words and stay; rows with
    equal doc_id and text stay or go together.
    """
    rows = deduped(documents, min_words).where((F.col("_n_deleted") == 0) | (F.col("_n_deleted") < F.col("_n_lines")))
    counted = {"n_chars": F.when(F.col("_n_deleted") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {}
    return rows.withColumns(counted).select(*[F.col(f"`{c}`") for c in documents.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all of `documents` without later copies of line runs of 50 words or more."""
    rows = deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), "text")


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents
), words AS (
  SELECT doc_id, no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw
), lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS s FROM words WHERE w > 0
), same AS (
  SELECT b.doc_id, b.s, b.w, a.doc_id AS other, b.s - a.s AS diagonal
  FROM lines a JOIN lines b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.s < b.s))
), islands AS (
  SELECT *, s - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY s) AS island FROM same
), runs AS (
  SELECT doc_id, other, diagonal, island, min(s) AS s1, max(s) AS s2 FROM islands GROUP BY ALL HAVING sum(w) >= 50
), gone AS (
  SELECT DISTINCT l.doc_id, l.no FROM lines l JOIN runs r ON l.doc_id = r.doc_id AND l.s BETWEEN r.s1 AND r.s2
), kept AS (
  SELECT w.doc_id, string_agg(w.line, chr(10) ORDER BY w.no) FILTER (WHERE g.no IS NULL) AS text,
         count(*) FILTER (WHERE w.w > 0) AS n_lines, count(g.no) AS n_deleted
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.no = g.no GROUP BY w.doc_id
)
SELECT d.doc_id, k.n_lines, k.n_deleted, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d JOIN kept k ON d.doc_id = k.doc_id
"""
