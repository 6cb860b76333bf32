"""Quality rules: repetition coverage.

For several n-gram lengths the rolling hashes of all word n-grams of a text
are computed in numpy, and the characters inside n-grams that occur twice or
more are measured, as are the characters of repeated lines. Thresholds grow
stricter with the n-gram's length. Equal hashes are confirmed word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fathom.llm._common import batches, table

#: Largest share of characters inside duplicated n-grams, by n-gram length.
DUPLICATE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters inside the n-gram that fills most of the text, of those found three times or more, by n-gram length.
TOP_LIMITS = {2: 0.12, 3: 0.11, 4: 0.10}
#: Largest share of characters in lines equal to an earlier line.
LINE_LIMIT = 0.20
#: The base rule's window, its least number of words and its largest share of repeated words.
BASE_WINDOW, BASE_WORDS, BASE_SHARE = 5, 10, 0.20

_BLANK = re.compile("[\x20\x09-\x0d]")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_ngram_share double, top_ngram_share double, dup_line_share double"


def _scattered(ids: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values of small numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
    x ^= x >> np.uint64(32)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def _groups(ids: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in order of their hash, the start of each group of equal windows in it, and the groups' sizes."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    same = np.flatnonzero(~new)
    if len(same):
        a, b = order[same - 1], order[same]
        if not all(np.array_equal(ids[a + j], ids[b + j]) for j in range(n)):  # a collision: compare the words themselves
            _, inverse = np.unique(np.lib.stride_tricks.sliding_window_view(ids, n), axis=0, return_inverse=True)
            return _groups(ids, inverse.reshape(-1).astype(np.uint64), n)
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(order)))


def _covered(places: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie in windows of n words that start at places."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + n, total), -1)
    return np.cumsum(edge[:total]) > 0


def measure(text: str | None) -> tuple[int, int, int, int, int, float, float, float]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, worst duplicate, top and line share).

    A share is relative to its limit: above 1 it breaks the rule.
    """
    if not text:
        return 0, 0, 0, 0, 0, 0.0, 0.0, 0.0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() separates at exactly the six ASCII spaces
    total = len(words)
    n_symbols = len(_SYMBOL.findall(text))
    if not total:
        return 0, 0, n_symbols, 0, 0, 0.0, 0.0, 0.0
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    word_chars = len(text) - blanks
    seen: set[str] = set()
    dup_lines = dup_chars = line_chars = 0
    for line in text.split("\n"):
        size = len(line) - sum(map(line.count, " \t\v\f\r"))
        if size:
            line_chars += size
            if line in seen:
                dup_lines += 1
                dup_chars += size
            else:
                seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=total)
    chars = np.fromiter(((len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass"))) for w in number), dtype=np.int64, count=len(number))[ids]
    values = _scattered(ids)
    rolling = values.copy()
    repeat_words, dup_share, top_share = 0, 0.0, 0.0
    for n in range(2, max(DUPLICATE_LIMITS) + 1):
        if total < n:
            break
        # hash of n words from the hash of n - 1 words: h * step + the word that comes in
        rolling = rolling[:-1] * _STEP + values[n - 1 :]
        rolling ^= rolling >> np.uint64(31)
        if len(number) == total:
            continue  # no word twice, so no n-gram either
        order, starts, sizes = _groups(ids, rolling, n)
        if sizes.max() < 2:
            break  # longer n-grams can't repeat either
        if n in TOP_LIMITS:
            widths = np.cumsum(np.append(0, chars))
            firsts = order[starts]
            weight = sizes * (widths[firsts + n] - widths[firsts]) * (sizes > 2)
            best = int(np.argmax(weight))
            places = order[starts[best] : starts[best] + sizes[best]]
            top_share = max(top_share, float(chars[_covered(places, n, total)].sum()) / word_chars / TOP_LIMITS[n])
        if n in DUPLICATE_LIMITS or n == BASE_WINDOW:
            covered = _covered(order[np.repeat(sizes > 1, sizes)], n, total)
            if n == BASE_WINDOW:
                repeat_words = int(covered.sum())
            dup_share = max(dup_share, float(chars[covered].sum()) / word_chars / DUPLICATE_LIMITS[n])
    return total, word_chars, n_symbols, dup_lines, repeat_words, dup_share, top_share, dup_chars / line_chars / LINE_LIMIT


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        found = [measure(text.as_py()) for text in part.column(1)]
        n_words, word_chars, n_symbols, dup_lines, repeats, dup, top, line = ([*x] for x in zip(*found, strict=True)) if found else ([],) * 8
        failed = [n < BASE_WORDS or 100 * r > 100 * BASE_SHARE * n for n, r in zip(n_words, repeats, strict=True)]
        kept = [not f and max(x) <= 1 for f, *x in zip(failed, dup, top, line, strict=True)]
        yield pa.record_batch(
            [part.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, dup_lines, repeats)), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), *(pa.array(x, pa.float64()) for x in (dup, top, line))],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )


def quality(documents: DataFrame) -> DataFrame:
    """One row per row of documents (doc_id, text; other columns are ignored).

    Counts cover the whole text. A null, empty or blank text has no words,
    fails the base rule and isn't kept. Repeated rows are judged each on their
    own; a null doc_id is returned as it is. There is no shuffle.
    """
    batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_rows, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the rules over the whole of `documents`."""
    return quality(table(spark, sf_dir, "documents"))


def base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL expresses too."""
    return query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_W = r"[^\x20\x09-\x0D]+"
BASE_ORACLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{_W}'), []) AS w FROM documents
), a AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM r) GROUP BY 1
), o AS (
  SELECT a.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM a LEFT JOIN c ON a.doc_id = c.doc_id
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o
"""
