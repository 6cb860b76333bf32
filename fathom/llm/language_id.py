"""Language identification by hierarchical discrimination.

Texts become hashed counts of byte 2- to 4-grams of the lower-cased letters.
Linear support vector machines, one for each pair of language families, vote
for the family first; inside it, one machine for each pair of languages
separates the closely related ones. Everything is learned from a bounded,
deterministic sample of labelled rows; texts are predicted whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm._common import batches, table

#: Families of some languages by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
}
#: Languages' sample: rows of each language, rows of all, the least of each however many there are, and the languages, the most frequent first, that are learned at most.
PER_LANGUAGE, PER_SAMPLE, LEAST, MOST_LANGUAGES = 300, 6000, 20, 256
#: Features; and the pieces, in words, by which every sampled text is learned beside the whole, for short texts.
DIMENSIONS = 4096
PIECES = (2, 6, 20, 60)
#: Below this score a prediction counts as rejected, as does `und`. A class that only just wins all its votes scores 0.25, or 0.5 if its family has no other; at the learned margins it scores 0.78 or more.
#: Texts of languages that weren't learned, random letters and hex digits mostly score 0.28 to 0.6.
MIN_SCORE = 0.6
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
_BITS = DIMENSIONS.bit_length() - 1


def family(lang: str) -> str:
    """The family of a language code; region and script suffixes don't matter."""
    code = re.split("[-_]", lang.lower())[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"={code}")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed byte n-gram counts of a whole text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split()) + b" "
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS)
    gram = a
    for n in (2, 3, 4):
        if len(a) < n:
            break
        gram = (gram[:-1] << np.uint32(8)) | a[n - 1 :]
        counts += np.bincount(((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - _BITS), minlength=DIMENSIONS)
    x = np.sqrt(counts)
    return (x / max(1e-9, float(np.sqrt((x * x).sum())))).astype(np.float32)


@dataclass
class Votes:
    """One-versus-one linear machines over classes."""

    classes: list[str]
    weights: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and its least margin against another class, for each row of x."""
        if len(self.classes) == 1:
            return np.zeros(len(x), dtype=int), np.full(len(x), np.inf)
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, least = np.zeros((len(x), len(self.classes))), np.full((len(x), len(self.classes)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        best = np.argmax(votes + np.clip(least, -1, 1) * 1e-3, axis=1)
        return best, least[np.arange(len(x)), best]


@dataclass
class Model:
    families: Votes
    within: dict[str, Votes]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        which, margin = self.families.decide(x)
        sure = 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))
        langs: list[str] = [""] * len(x)
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(which == k)
            if len(rows):
                lang, own = self.within[name].decide(x[rows])
                sure[rows] *= 1 / (1 + np.exp(-2 * np.clip(own, -20, 20)))
                for row, i in zip(rows, lang, strict=True):
                    langs[row] = self.within[name].classes[i]
        return langs, sure


def _machine(x: np.ndarray, norms: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss over some rows of x, by dual coordinate descent in a fixed random order; classes weigh alike. Rows aren't copied."""
    each = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    ridge = 1 / (2 * cost * each)
    square = norms[rows] + ridge
    w, alpha, order = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            row = x[rows[i]]
            gradient = y[i] * float(w @ row) - 1 + ridge[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * row
                alpha[i] = new
    return w


def _votes(x: np.ndarray, norms: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> Votes:
    """Machines for each pair of the labels of some rows; the last column of x is 1, for the bias."""
    classes = sorted(set(labels[rows]))
    pairs, weights = list(combinations(range(len(classes)), 2)), []
    for i, j in pairs:
        own = rows[(labels[rows] == classes[i]) | (labels[rows] == classes[j])]
        weights.append(_machine(x, norms, own, np.where(labels[own] == classes[i], 1.0, -1.0)))
    return Votes(classes, np.array(weights, dtype=np.float32).reshape(len(pairs), x.shape[1]), pairs)


def _pieces(text: str) -> Iterator[str]:
    """The whole text, and a piece of each length from a place that depends on the text alone."""
    yield text
    words = text.split()
    for n in PIECES:
        if len(words) > n:
            start = (len(text) * 31 + n * 7) % (len(words) - n)
            if has_letter(piece := " ".join(words[start : start + n])):
                yield piece


def _learned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        langs, places, values = [], [], []
        for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            if has_letter(text := text.as_py()):
                for piece in _pieces(text):
                    x = features(piece)
                    at = np.flatnonzero(x)
                    langs.append(lang)
                    places.append(at.astype(np.uint16).tobytes())
                    values.append(x[at].tobytes())
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["lang", "places", "x"])


def held_out(doc_id: Column) -> Column:
    """True for documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame) -> Model | None:
    """Learns from text and lang of rows whose doc_id isn't null or held out; None if there is no such row.

    At most PER_LANGUAGE rows of a language and about PER_SAMPLE of all are
    taken, in the order of a hash of doc_id; they reach the driver as sparse
    features. A bound on the hash, from each language's number of ids, leaves
    about twice as many ids before they are ranked, however many tasks there
    are. Of rows that share a doc_id the one with the smallest lang and text
    is learned from. Of more than MOST_LANGUAGES languages the most frequent
    are learned.
    """
    spark = documents.sparkSession
    batches(spark)
    usable = documents.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    each = max(LEAST, min(PER_LANGUAGE, PER_SAMPLE // len(counts)))
    bounds = [(r["lang"], min(2**63 - 1, -(2**63) + int(2**64 * (2 * each + 60) / max(1, r["n"])))) for r in counts]
    bounds = F.broadcast(spark.createDataFrame(bounds, "lang string, bound long"))
    hashed = F.xxhash64("doc_id")
    near = usable.select("doc_id", "lang").join(bounds, "lang").where(hashed <= F.col("bound")).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("doc_id").distinct()
    ids = [r[0] for r in chosen.collect()]  # at most each * languages
    if not ids:
        return None
    # One row of each id, so that rows which share one don't all reach the driver.
    once = usable.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    sample = once.select("row.lang", "row.text").mapInArrow(_learned, "lang string, places binary, x binary")
    rows = sorted(map(tuple, sample.collect()), key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    if not rows:
        return None
    x = np.zeros((len(rows), DIMENSIONS + 1), dtype=np.float32)
    x[:, -1] = 1
    for i, (_, at, values) in enumerate(rows):
        x[i, np.frombuffer(at, dtype=np.uint16)] = np.frombuffer(values, dtype=np.float32)
    langs = np.array([r[0] for r in rows], dtype=object)
    del rows
    families = np.array([family(r) for r in langs], dtype=object)
    norms, every = np.einsum("ij,ij->i", x, x), np.arange(len(x))
    return Model(_votes(x, norms, every, families), {f: _votes(x, norms, every[families == f], langs) for f in sorted(set(families))})


def _predictor(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predicted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            at, xs = [], []
            for i, text in enumerate(part.column(0)):
                if model and has_letter(text := text.as_py()):
                    at.append(i)
                    xs.append(features(text))
            if at:
                for i, lang, score in zip(at, *model.predict(np.array(xs)), strict=True):
                    langs[i], scores[i] = lang, score
            yield pa.record_batch([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names[1:], "lang_pred", "score"])

    return predicted


def predict(documents: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The columns keep, lang_pred and score (0 to 1) of each row of documents; only text is looked at.

    `und` with score 0 stands for a null, empty or letterless text, or for any
    text if nothing could be learned. Repeated rows are predicted each alike.
    There is no shuffle.
    """
    batches(documents.sparkSession)
    kept = [documents.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])
    return documents.select("text", *keep).mapInArrow(_predictor(model), schema)


def filtered(documents: DataFrame) -> DataFrame:
    """documents without the rows whose language can't be told; columns, of any name and type, stay as they are.

    Null, empty and letterless texts go, and those that no learned language
    wins by a clear margin (MIN_SCORE); repeated rows stay or go together. If
    nothing can be learned, no language can be told and no row stays.
    """
    model = fit(documents)
    if model is None:
        return documents.limit(0)
    return documents.where(_accepts(model)(F.col("text")))


def _accepts(model: Model):
    def judged(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), dtype=bool)
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        for start in range(0, len(at), 256):
            some = at[start : start + 256]
            _, scores = model.predict(np.array([features(texts.iloc[i]) for i in some]))
            out[some] = scores >= MIN_SCORE
        return pd.Series(out)

    return F.pandas_udf(judged, "boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's language; nothing is learned from held-out documents."""
    documents = table(spark, sf_dir, "documents")
    found = predict(documents, fit(documents), "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
