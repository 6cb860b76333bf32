"""URL filters: rules in a sorted digest array.

Rules are (host, path prefix) pairs with a verdict. The 64-bit xxhash of each
rule lies sorted in files that workers map into memory, SHARD_RULES rules to a
file, each file a range of digests. Of a batch of URLs the host suffixes and
path prefixes that some rule may have are hashed and probed at once by a
vectorised binary search. A hit counts only if the rule's full string, stored
behind the digests, equals the probed one.

Rules from a list and rules from a table make the same files, so that both are
judged alike whatever their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm._common import batches, drop_stored, lowered, scratch_dir, stored, table

#: Verdict of a URL that no rule fits.
DEFAULT = "allow"
#: Rules of one file.
SHARD_RULES = 1_000_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
#: The seed of Spark's xxhash64, by which rules of a table are dealt.
SEED = 42

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first `://` up to `/`, `?`, `#` or the end; then up to `?`, `#` or the end."""
    start = url.find("://") if url else -1
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def usable(host: str | None, path: str | None, verdict: str | None) -> bool:
    """Whether a rule can fit a URL at all: it has a host without `/`, `?` and `#`, a path that is empty or starts with `/`, and a verdict without newlines."""
    return bool(host) and path is not None and bool(verdict) and not set(host) & set("/?#") and path[:1] in ("", "/") and "\n" not in verdict


def distinct(rules: Iterable[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """The usable rules with hosts lower-cased; a later rule for the same host and path replaces an earlier one."""
    verdicts = {(host.translate(_LOWER), path): verdict for host, path, verdict in rules if usable(host, path, verdict)}
    return [(host, path, verdict) for (host, path), verdict in verdicts.items()]


def _digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), seed=SEED)


def pack(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """A file of distinct (host, path, verdict) rules: number of rules, sorted digests, offsets, strings."""
    entries = sorted((_digest(host + path), f"{host + path}\n{verdict}".encode("utf-8", "surrogatepass")) for host, path, verdict in rules)
    offsets = np.cumsum([0, *(len(s) for _, s in entries)])
    return np.array([len(entries)], dtype="<u8").tobytes() + np.array([d for d, _ in entries], dtype="<u8").tobytes() + offsets.astype("<u8").tobytes() + b"".join(s for _, s in entries)


class Shard:
    """A packed file, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(data[:8].view("<u8")[0])
        self.digests = data[8 : 8 + 8 * n].view("<u8")
        self.offsets = data[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.strings = data[16 + 16 * n :]

    def probe(self, keys: list[str], digests: np.ndarray, wanted: np.ndarray, found: list[str | None]) -> None:
        """Puts the verdict stored for each wanted key into found."""
        if not len(self.digests) or not len(wanted):
            return
        places = np.searchsorted(self.digests, digests[wanted])
        hits = np.flatnonzero(self.digests[np.minimum(places, len(self.digests) - 1)] == digests[wanted])
        for h in hits:
            i, place = int(wanted[h]), int(places[h])
            while place < len(self.digests) and self.digests[place] == digests[i]:  # rules that share a digest
                rule, _, verdict = bytes(self.strings[int(self.offsets[place]) : int(self.offsets[place + 1])]).decode("utf-8", "surrogatepass").rpartition("\n")
                if rule == keys[i]:
                    found[i] = verdict
                    break
                place += 1


class Index:
    """The files of all rules, in the order of their digests, and what rules may look like.

    shapes are the different (labels of the host, characters of the path);
    longest is the greatest number of characters of a host. Only such suffixes
    and prefixes of a URL are probed, so that a URL's length costs nothing
    beyond what the rules ask for.
    """

    def __init__(self, paths: list[str], starts: list[int], shapes: list[tuple[int, int]], longest: int):
        self.shards = [Shard(p) for p in paths]
        self.starts = np.array(starts, dtype=np.uint64)
        self.longest = longest
        self.lengths: dict[int, list[int]] = {}
        for labels, length in sorted(shapes):
            self.lengths.setdefault(labels, []).append(length)

    def probe(self, keys: list[str]) -> list[str | None]:
        """The verdict stored for each key, or None."""
        found: list[str | None] = [None] * len(keys)
        if keys and self.shards:
            digests = np.fromiter(map(_digest, keys), dtype=np.uint64, count=len(keys))
            home = np.searchsorted(self.starts, digests, side="right") - 1
            for k, shard in enumerate(self.shards):
                shard.probe(keys, digests, np.flatnonzero(home == k), found)
        return found

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of each URL; of the rules that fit, the longest wins, of equally long ones that with the longer host."""
        parts = [split_url(u) for u in urls]
        keys, owners = [], []
        for i, (host, path) in enumerate(parts):
            if not host:
                continue
            at = len(host)
            for labels in range(1, max(self.lengths, default=0) + 1):
                at = host.rfind(".", 0, at)
                if len(host) - at - 1 > self.longest:
                    break
                for n in self.lengths.get(labels, ()):
                    if n > len(path):
                        break
                    keys.append(host[at + 1 :] + path[:n])
                    owners.append(i)
                if at < 0:
                    break
        best: list[tuple[str | None, str]] = [(None, DEFAULT)] * len(urls)
        for key, owner, verdict in zip(keys, owners, self.probe(keys), strict=True):
            if verdict is not None and (best[owner][0] is None or len(key) >= len(best[owner][0])):
                best[owner] = key, verdict
        return [(*p, *b) for p, b in zip(parts, best, strict=True)]


def _published(spark: SparkSession, data: bytes) -> str:
    """Puts a file in the shared folder and has Spark bring it to every executor; returns its name."""
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, False)
    for at in range(0, len(data), 8 << 20):
        out.write(bytearray(data[at : at + (8 << 20)]))
    out.close()
    spark.sparkContext.addFile(str(fs.makeQualified(path).toString()))
    return name


def _of_list(rules: list[tuple[str, str, str]]) -> tuple[Iterator[tuple[int, bytes]], list[tuple[int, int]], int]:
    """(first digest, bytes) of each file, shapes and longest host of rules in the driver's memory."""
    rules = sorted(distinct(rules), key=lambda r: _digest(r[0] + r[1]))
    shapes = sorted({(host.count(".") + 1, len(path)) for host, path, _ in rules})
    files = ((_digest("".join(rules[at][:2])), pack(rules[at : at + SHARD_RULES])) for at in range(0, len(rules), SHARD_RULES))
    return files, shapes, max((len(host) for host, _, _ in rules), default=0)


def _packed_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for part in parts for r in zip(*(part.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True)]
    if rows:
        data = pack(rows)
        yield pa.record_batch([pa.array([int(np.frombuffer(data[8:16], dtype="<u8")[0]).to_bytes(8, "big")], pa.binary()), pa.array([data], pa.binary())], names=["start", "data"])


def _of_table(rules: DataFrame) -> tuple[Iterator[tuple[int, bytes]], list[tuple[int, int]], int]:
    """As _of_list() for a table; one file at a time reaches the driver."""
    good = rules.where("host <> '' AND path IS NOT NULL AND verdict <> ''").where(~F.col("host").rlike("[/?#]") & F.col("path").rlike("^(/|$)") & ~F.contains("verdict", F.lit("\n")))
    good = good.select(lowered(F.col("host")).alias("host"), "path", "verdict", "position")
    last = Window.partitionBy("host", "path").orderBy(F.desc("position"), F.desc("verdict"))
    one = stored(good.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("host", "path", "verdict"))
    labels = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    shapes = [(r[0], r[1]) for r in one.select(labels, F.length("path")).distinct().collect()]
    n, longest = one.agg(F.count("*"), F.coalesce(F.max(F.length("host")), F.lit(0))).first()
    # Digests are unsigned: without their sign bit signed numbers sort like them.
    order = F.xxhash64(F.concat("host", "path")).bitwiseXOR(F.lit(-(2**63)))
    dealt = one.repartitionByRange(max(1, -(-n // SHARD_RULES)), order)
    files = stored(dealt.mapInArrow(_packed_rows, "start binary, data binary")).orderBy("start")
    drop = [one]

    def one_by_one() -> Iterator[tuple[int, bytes]]:
        for row in files.toLocalIterator():
            yield int.from_bytes(row["start"], "big"), bytes(row["data"])
        drop_stored(*drop)

    return one_by_one(), shapes, longest


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url; other columns are ignored).

    rules are (host, path, verdict) in a list, or a table with these columns
    and position; of rules with one host, in any case of A to Z, and path the
    last counts. Rules that can't fit a URL (usable()) are left out. A null
    url or one without `://` has an empty host and path, fits no rule and gets
    the default verdict, as does every url if there are no rules. Repeated
    rows are judged each alike. Pages aren't shuffled.
    """
    spark = pages.sparkSession
    batches(spark)
    files, shapes, longest = _of_table(rules) if isinstance(rules, DataFrame) else _of_list(rules)
    names, starts = [], []
    for start, data in files:
        names.append(_published(spark, data))
        starts.append(start)

    def judged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([SparkFiles.get(n) for n in names], starts, shapes, longest)
        for part in parts:
            found = list(zip(*index.judge(part.column(1).to_pylist()), strict=True)) or [()] * 4
            yield pa.record_batch([part.column(0).cast(pa.int64()), *(pa.array(x, pa.string()) for x in found)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(judged, SCHEMA)


#: The rules of op6: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^([^/]*)', 1)) + 1) AS path
  FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
