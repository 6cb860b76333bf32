"""Byte-level BPE by a sentencepiece model that is made from the vocabulary itself.

Each byte stands for one printable character, so that a token of the rank
file becomes a piece of characters; its score is its negative rank. A model of
type BPE then joins the best-ranked neighbours first, the leftmost of several
alike, as the ranks ask. Normalisation is the identity. Texts are cut into
pre-tokens by the vocabulary's pattern, and each is encoded on its own; one
that is a token as a whole is that token, whatever its joins would give.
Decoding maps the ids' pieces back to bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece.sentencepiece_model_pb2 import ModelProto, TrainerSpec

from fathom.llm._common import batches, table

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens of a text that are held at a time; those that a worker remembers, about, none of them longer than so many characters.
CHUNK, KEPT, KEPT_CHARS = 1 << 16, 1 << 18, 64


def byte_characters() -> str:
    """The character of each byte: itself if Latin-1 prints it, else the next one from U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in printed)
    places = {b: 0x100 + i for i, b in enumerate(rest)}
    return "".join(chr(places.get(b, b)) for b in range(256))


def read_ranks(name: str = RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece i is the token of rank i; the unknown piece, which no text of bytes needs, comes last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, ... without gaps")
    to_characters = dict(enumerate(byte_characters()))
    model = ModelProto()
    for token in sorted(ranks, key=ranks.get):
        model.pieces.add(piece=token.decode("latin-1").translate(to_characters), score=-float(ranks[token]))
    model.pieces.add(piece="<unk>", score=0.0, type=ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(ranks)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    spec = model.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    """Encodes texts and decodes ids; one per process and vocabulary, see codec()."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.model = SentencePieceProcessor(model_proto=serialised(ranks))
        self.pattern = regex.compile(pattern)
        characters = byte_characters()
        self.to_characters = dict(enumerate(characters))
        to_bytes = {ord(c): b for b, c in enumerate(characters)}
        pieces = [self.model.id_to_piece(i) for i in range(len(ranks))]
        self.whole = {p: (i,) for i, p in enumerate(pieces)}
        self.bytes_of = [p.translate(to_bytes).encode("latin-1") for p in pieces]
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pre-tokens that aren't known yet."""
        found, rest = {}, []
        for word in words:
            mapped = word.encode().decode("latin-1").translate(self.to_characters)
            if mapped in self.whole:
                found[word] = self.whole[mapped]
            else:
                rest.append((word, mapped))
        for (word, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1), strict=True):
            found[word] = tuple(ids)
        return found

    def chunks(self, text: str) -> Iterator[np.ndarray]:
        """A text's ids, some ten thousand pre-tokens at a time."""
        words = (m[0] for m in self.pattern.finditer(text)) if len(text) > CHUNK else iter(self.pattern.findall(text))
        while part := list(islice(words, CHUNK)):
            if len(self.known) > KEPT:
                self.known = {}
            known = self.known
            new = self._learn(set(part).difference(known))
            known.update(new)
            yield np.fromiter(chain.from_iterable(map(known.__getitem__, part)), dtype="<u4")
            for word in new:
                if len(word) > KEPT_CHARS:
                    del known[word]

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype="<u4"), *self.chunks(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def codec(name: str = RANKS) -> Codec:
    return Codec(read_ranks(name))


def encoded(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids for each row of docs (doc_id, text, whatever else): ids are little-endian unsigned 32-bit integers in one binary value, as np.frombuffer(ids, "<u4") reads them.

    A null or empty text has none. Repeated rows each give a row; special
    tokens' names in a text are ordinary text. Rows are independent: no shuffle.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for part in parts:
            ids = (b"".join(x.tobytes() for x in own.chunks(t.as_py() or "")) for t in part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("ids", "binary"))


def decoded(rows: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids, bytes for each row of encoded(): the bytes that the ids stand for. Null ids give null; an id outside the vocabulary raises."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for part in parts:
            found = (None if x is None else own.decode(np.frombuffer(x, dtype="<u4")) for x in part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["doc_id", "ids", "bytes"])

    batches(rows.sparkSession)
    return rows.select("doc_id", "ids").mapInArrow(run, rows.select("doc_id", "ids").schema.add("bytes", "binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every text of `documents` encoded and decoded again, as digests."""
    rows = decoded(encoded(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.shiftright(F.length("ids"), 2).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
