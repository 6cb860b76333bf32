"""Token counts as delta-maintained rollups.

A ledger holds, for each document and tokenizer version, what it counts for.
A batch of inserts, revised counts and deletes is turned into signed deltas
against the ledger, and totals by source, language and tokenizer version are
the sums of all committed deltas. A batch writes its entries and deltas first
and its marker last: a batch without a marker doesn't count and is written
anew, one with a marker is never applied again.

Entries are dealt by a hash of their key into buckets, and a batch reads only
the buckets it touches. Every COMPACT_AFTER batches a commit leaves a snapshot
of the entries and of the totals, and later ones read the snapshot and the
batches behind it, not all that was ever written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm._common import batches, n_words, scratch_dir, stored, table
from fathom.llm.tokenizer import RANKS, token_ids

KEY = ("doc_id", "tokenizer_version")
GROUP = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_chars")
ENTRY = "doc_id long, tokenizer_version string, source string, lang string, n_docs long, n_tokens long, n_chars long"
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"


#: Buckets of entries by key, and batches from one snapshot to the next.
BUCKETS, COMPACT_AFTER = 32, 8


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int").alias("bucket")


def _same(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in KEY]


class TokenLedger:
    """Rollups kept under a folder that driver and executors share.

    Commits are made one after another by one writer. `batch_id` names a batch
    once and for all: committing it again, whatever it holds, changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marked(self, folder: str) -> list[tuple[int, str]]:
        folder = self._path(f"{self.root}/{folder}")
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(n), batch) for n, _, batch in (name.partition("-") for name in names))

    def _mark(self, folder: str, name: str) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/{folder}"))
        self._fs.create(self._path(f"{self.root}/{folder}/{name}"), False).close()

    def committed(self) -> list[tuple[int, str]]:
        """(number, batch_id) of the committed batches in order."""
        return self._marked("commits")

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The last snapshot's rows as batch -1, and those of the batches behind it."""
        snapshot = max((n for n, _ in self._marked("snapshots")), default=-1)
        parts = [(-1, f"{self.root}/{kind}/snapshot-{snapshot}")] if snapshot >= 0 else []
        parts += [(n, f"{self.root}/{kind}/{n}-{batch}") for n, batch in self.committed() if n > snapshot]
        rows = self.spark.createDataFrame([], f"{schema}, batch int")
        for number, path in parts:
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(path).withColumn("batch", F.lit(number)))
        return rows

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """What each document counts for now, with its bucket: the rows of the last batch that names its key; of some buckets only if asked."""
        rows = self._read("entries", f"{ENTRY}, bucket int")
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        last = rows.groupBy(*KEY).agg(F.max("batch").alias("last"))
        return rows.alias("e").join(last.alias("l"), [*_same("e", "l"), F.col("batch") == F.col("last")], "left_semi").where(F.col("n_docs") > 0).drop("batch")

    def _write_entries(self, rows: DataFrame, name: str) -> None:
        # Few files for each bucket, and as many tasks as there are shuffle partitions.
        salts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        rows.repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(salts))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/entries/{name}")

    def commit(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Applies a batch; False if it had been committed before.

        upserts (doc_id, tokenizer_version, source, lang, n_tokens, n_chars)
        insert documents or revise them: all rows with a document's key
        together replace what the ledger has for the key. deletes (doc_id,
        tokenizer_version) remove keys; unknown ones change nothing, and a key
        in both is revised. Nulls are values like others: documents without id
        share one key. Rows of a key are added up before they are joined.
        """
        done = self.committed()
        if batch_id in {b for _, b in done}:
            return False
        number = 1 + max((n for n, _ in done), default=-1)
        name = f"{number}-{batch_id}"
        new = self.spark.createDataFrame([], ENTRY)
        if upserts is not None:
            new = upserts.groupBy(*KEY, "source", "lang").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("n_chars"))
        if deletes is not None:
            if upserts is not None:
                new = stored(new)
            named = deletes.select(*KEY).distinct()
            named = named.alias("d").join(new.select(*KEY).distinct().alias("n"), _same("d", "n"), "left_anti")
            new = new.unionByName(named.select(*KEY, F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), *(F.lit(0).cast("long").alias(c) for c in SUMS)))
        self._write_entries(new.withColumn("bucket", _bucket()), name)
        written = self.spark.read.schema(f"{ENTRY}, bucket int").parquet(f"{self.root}/entries/{name}")
        signed = written.where(F.col("n_docs") > 0).select(*GROUP, *SUMS)
        if done:
            touched = [r[0] for r in written.select("bucket").distinct().collect()]  # BUCKETS at most
            old = self.entries(touched).alias("o").join(written.select(*KEY).distinct().alias("t"), _same("o", "t"), "left_semi")
            signed = signed.unionByName(old.select(*GROUP, *((-F.col(c)).alias(c) for c in SUMS)))
        deltas = signed.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/{name}")
        self._mark("commits", name)
        if number - max((n for n, _ in self._marked("snapshots")), default=-1) >= COMPACT_AFTER:
            self.compact()
        return True

    def compact(self) -> None:
        """Leaves a snapshot of what the committed batches come to. It counts once its marker is there; one that dies before is written anew."""
        done = self.committed()
        if not done:
            return
        number = done[-1][0]
        if number in {n for n, _ in self._marked("snapshots")}:
            return
        self._write_entries(self.entries(), f"snapshot-{number}")
        self.totals().write.mode("overwrite").parquet(f"{self.root}/deltas/snapshot-{number}")
        self._mark("snapshots", f"{number}-")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens, n_chars; groups without documents are left out."""
        sums = self._read("deltas", DELTA).groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))
        return sums.where(F.col("n_docs") != 0)


def _counter(version: str, ranks: str):
    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tokens = [len(token_ids(t, ranks)) if (t := text.as_py()) else 0 for text in part.column("text")]
            yield pa.record_batch(
                [part.column("doc_id").cast(pa.int64()), pa.array([version] * part.num_rows, pa.string()), part.column("source"), part.column("lang"), pa.array(tokens, pa.int64()), part.column("n_chars")],
                names=["doc_id", "tokenizer_version", "source", "lang", "n_tokens", "n_chars"],
            )

    return counted


def counted(documents: DataFrame, version: str = "byte_bpe_50k", ranks: str = RANKS) -> DataFrame:
    """Upserts for every row of documents (doc_id, source, lang, text): tokens and characters of the whole text, 0 for a null one."""
    batches(documents.sparkSession)
    rows = documents.select("doc_id", "source", "lang", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return rows.mapInArrow(_counter(version, ranks), "doc_id long, tokenizer_version string, source string, lang string, n_tokens long, n_chars long")


def counted_words(documents: DataFrame) -> DataFrame:
    """As counted(), with white-space words for tokens and without Python."""
    return documents.select("doc_id", F.lit("words").alias("tokenizer_version"), "source", "lang", n_words(F.col("text")).alias("n_tokens"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


def measured(documents: DataFrame, version: str, tokens: Column) -> DataFrame:
    """Upserts with a count by expression: estimates, which later batches revise, need no tokenizer."""
    return documents.select("doc_id", F.lit(version).alias("tokenizer_version"), "source", "lang", F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: totals of all of `documents` after four batches, each committed twice.

    The first inserts word counts and, as an estimate, a quarter of the bytes
    for the tokenizer's count; the second adds bytes under a version of their
    own; the third revises the estimates by the ids of the tokenizer; the
    fourth deletes the bytes of all documents. What is left are word counts
    and true token counts. Repeats change nothing.
    """
    documents = table(spark, sf_dir, "documents")
    size = F.octet_length("text")
    ledger = TokenLedger(spark, f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}")
    batches_ = [
        ("insert", counted_words(documents).unionByName(measured(documents, "byte_bpe_50k", F.ceil(size / 4))), None),
        ("bytes", measured(documents, "bytes", size), None),
        ("revise", counted(documents), None),
        ("delete", None, documents.select("doc_id", F.lit("bytes").alias("tokenizer_version"))),
    ]
    for name, upserts, deletes in batches_:
        for _ in range(2):
            ledger.commit(name, upserts, deletes)
    return ledger.totals()


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op7 that SQL expresses too: those of the words' version, and whether the other version has the same documents."""
    rows = query(spark, sf_dir)
    other = rows.where("tokenizer_version <> 'words'").select(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("n_docs").alias("d"), F.col("n_chars").alias("c"))
    words = rows.where("tokenizer_version = 'words'")
    return words.join(other, F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")), "full").select("source", "lang", "n_docs", "n_tokens", "n_chars", ((F.col("d") == F.col("n_docs")) & (F.col("c") == F.col("n_chars"))).alias("alike"))


WORD_ORACLE = r"""
SELECT source, lang, count(*) AS n_docs, CAST(sum(len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []))) AS BIGINT) AS n_tokens,
  CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars, true AS alike FROM documents GROUP BY source, lang
"""
