"""Best-fit packing of documents into training sequences.

Every document becomes token ids and an end token; longer ones are cut into
full pieces behind a shorter first one. Pieces are then packed by vector
best-fit, longest first: a bin has residual capacities of tokens, documents
and attention cost (the sum of squared lengths), and of all bins with room
under every constraint the one with the least weighted residual norm, or the
greatest weighted dot product, takes the piece; of several alike the oldest.

Packing is done in groups of bounded size, dealt by row; each group leaves
some bins part empty, so groups are large.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm._common import batches, stored, table
from fathom.llm.tokenizer import RANKS, token_ids

#: Id that ends every document.
END = 2
#: Pieces that one task packs together.
GROUP_ROWS = 65_536
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = f"{PIECE_SCHEMA}, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and how much each residual weighs in the choice of a bin.

    A sequence has at most `documents` pieces, so that its attention mask has
    a bounded number of blocks, and costs at most `attention`, so that no
    sequence of a batch is much slower than the others; a piece that alone
    costs more has a sequence of its own.
    """

    tokens: int = 1024
    documents: int = 32
    attention: int = 1010 * 1010
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-3)
    rule: str = "norm"


def pack(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each piece.

    Each piece looks at every open bin at once. Bins without any room left are
    dropped from time to time. A piece over a capacity gets a bin of its own.
    """
    n, full = len(lengths), np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.int64)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    left = np.zeros((3, max(1, n)), dtype=np.float64)  # residuals of the open bins, oldest first
    names = np.zeros(max(1, n), dtype=np.int64)
    factors = np.array(capacity.weights) / full.astype(float) ** 2
    least = int(lengths.min()) if n else 0
    open_ = opened = 0
    for step, i in enumerate(np.argsort(-lengths, kind="stable")):
        size = int(lengths[i])
        need = (float(size), 1.0, float(size * size))
        if step % 1024 == 1023:
            alive = np.flatnonzero((left[0, :open_] >= least) & (left[1, :open_] >= 1) & (left[2, :open_] >= least * least))
            left[:, : len(alive)], names[: len(alive)], open_ = left[:, alive], names[alive], len(alive)
        tokens, documents, attention = left[:, :open_]
        fits = np.flatnonzero(tokens >= size) if size < full[0] else np.zeros(0, dtype=np.int64)
        if len(fits):
            fits = fits[(documents[fits] >= 1) & (attention[fits] >= need[2])]
        if len(fits):
            if capacity.rule == "dot":
                score = -sum(f * x * r[fits] for f, x, r in zip(factors, need, left, strict=True))
            else:
                score = sum(f * (r[fits] - x) ** 2 for f, x, r in zip(factors, need, left, strict=True))
            at = int(fits[np.argmin(score)])
        else:
            at, open_ = open_, open_ + 1
            left[:, at], names[at] = full, opened
            opened += 1
        bins[i], offsets[i] = names[at], full[0] - int(left[0, at])
        left[:, at] -= need
    return bins, offsets


def _cutter(tokens: int, ranks: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            owner, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(part.column(1)):
                ids = np.append(token_ids(text.as_py() or "", ranks), np.uint32(END)).astype("<u4")
                first = len(ids) % tokens or tokens
                ends = range(first, len(ids) + 1, tokens)
                for k, end in enumerate(ends):
                    begin = max(0, end - tokens) if k else 0
                    owner.append(row)
                    piece.append(k)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(ids[begin:end].tobytes()))
            yield pa.record_batch(
                [part.column(0).cast(pa.int64()).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")],
            )

    return cut


def pieces(documents: DataFrame, tokens: int, ranks: str = RANKS) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length and the checksum of its ids."""
    batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_cutter(tokens, ranks), PIECE_SCHEMA)


def _packer(capacity: Capacity):
    def packed(key: tuple, group: pa.Table) -> pa.Table:
        bins, offsets = pack(group["length"].to_numpy(), capacity)
        sequence = (np.int64(key[0].as_py()) << np.int64(32)) + bins
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    return packed


def packed(documents: DataFrame, capacity: Capacity = Capacity(), ranks: str = RANKS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Of documents (doc_id, text; other columns are ignored) every row is
    packed, repeated rows each on their own and null ids as they are. A null
    or empty text is the end token alone. The pieces are stored once, so that
    rows keep their group whichever executor reads them; no group is larger
    than about GROUP_ROWS whatever the ids are.
    """
    cut = stored(pieces(documents, capacity.tokens, ranks))
    groups = max(1, -(-cut.count() // GROUP_ROWS))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInArrow(_packer(capacity), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all of `documents` in sequences of 1024 tokens; sequences hold 32 pieces and cost 1010 * 1010 pairs of tokens at most, but for single longer pieces."""
    return packed(table(spark, sf_dir, "documents"))
