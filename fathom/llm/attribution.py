"""Click-to-sale attribution as a stateful stream.

Each sale takes the last click of its client in the days before it, and how
many there were. Rows come in batches, in the order in which they arrived; a
sale is held until no click that counts for it can come any more, by a
watermark over both inputs.

State is kept for cells. A cell holds many small clients, so that one call of
Python handles thousands of rows with numpy; its two buffers, of clicks and of
sales, are packed arrays. A closing sale finds its clicks with two binary
searches in the sorted clicks, whose cumulated numbers give the count and
whose last one gives the click, of equal times that with the larger id. A cell
asks for a timeout at its earliest sale, so that it is called in a batch
without rows of its own too.

A client with so many rows that it would fill a cell is dealt by the hour:
clicks go to the cell of their hour; a sale goes, in three parts, to the cells
of the first and the last hour of its window and to one of several cells that
hold, for each hour and batch, only the number of clicks and the last one,
which serve the whole hours between. So no cell grows with a client, a click
is sent once and a sale three times, whatever the client's share of all rows.
The parts of a sale are put together at the end.

The exact watermark, in microseconds, is a constant of each batch's run, since
the query is started anew for every batch. Spark's own watermark counts
milliseconds and only decides which cells are called: each batch's rows carry
a clock that is at least the next batch's watermark and rises with every
batch, so that nothing is late for Spark and no timeout is missed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathom.llm._common import SHORT_ROWS, batches, held, scratch_dir, stored, table

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Later than any time in microseconds: the watermark that closes everything. The clock that goes with it, in milliseconds, is as late as pandas can tell; LATEST bounds the others, so that cells due later are called a batch early rather than never.
END, END_CLOCK, LATEST = 2**62, 9_000_000_000_000, 8_999_999_000_000
#: Parts of a sale: the whole window, or its last hour, its first hour and the whole hours between.
WHOLE, LAST, FIRST, BETWEEN = range(4)

ROWS = "cell long, client_id long, kind int, at long, id long, n long, since long, until long, part int"
FOUND = "sale_id long, client_id long, sold_at long, part int, batch int, late boolean, click_at long, click_id long, n_clicks long"
STATE = "clicks binary, sales binary"
CLICK = np.dtype([("client", "<i8"), ("at", "<i8"), ("id", "<i8"), ("n", "<i8")])
SALE = np.dtype([("client", "<i8"), ("at", "<i8"), ("id", "<i8"), ("since", "<i8"), ("until", "<i8"), ("part", "<i8")])
#: What stands for a missing id in the stream, whose columns have no nulls, so that pandas keeps whole numbers.
NONE = -(2**63)


@dataclass(frozen=True)
class Rules:
    """How long clicks count, how far the watermark lags, about how many rows a cell gets, and from which share of all rows on a client is dealt by the hour."""

    window: int = 7 * DAY
    lag: int = DAY
    cell_rows: int = 50_000
    hot_share: float = 1 / 1000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp, one without a zone taken as UTC whatever the session's zone."""
    x = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(x)
    of_day = F.hour(x) * F.lit(3600).cast("long") + F.minute(x) * 60
    second = (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("long")
    return F.unix_date(F.to_date(x)).cast("long") * F.lit(DAY) + of_day * 1_000_000 + second


def whole_hours(x: Column) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(HOUR)), F.lit(HOUR))


def arrival_hour(df: DataFrame, key: str, delay: int = 240) -> Column:
    """The hour in which a row counts as arrived: every fourth row, by the crc32 of its id, some days late. A missing id is no such row."""
    late = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 0, F.lit(False))
    return whole_hours(micros(df, "arrived_at")) + F.when(late, F.lit(delay)).otherwise(F.lit(0))


def in_batches(clicks: DataFrame, sales: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """clicks (batch, client_id, at, click_id) and sales (batch, client_id, at, sale_id), times in microseconds.

    Rows without a client or a time go, and of a click_id's others one stays,
    the smallest. Batches cut the hours of arrival of the clicks that stay into
    equal spans, sales outside of them belong to the nearest one, and rows
    without an arrival to the first. Without clicks everything is in it.
    """
    c = clicks.select("click_id", "client_id", micros(clicks, "ts").alias("at"), arrival_hour(clicks, "click_id").alias("h"))
    c = stored(c.where("client_id IS NOT NULL AND at IS NOT NULL").groupBy("click_id").agg(F.min(F.struct("client_id", "at", "h")).alias("r")).select("click_id", "r.*"))
    s = sales.select("sale_id", "client_id", micros(sales, "sold_at").alias("at"), arrival_hour(sales, "sale_id").alias("h")).where("client_id IS NOT NULL AND at IS NOT NULL")
    lo, hi = c.agg(F.min("h"), F.max("h")).first()
    if lo is None:
        batch = F.lit(0)
    else:
        cut = F.call_function("div", F.greatest(F.col("h") - lo, F.lit(0)) * number, F.lit(hi - lo + 1))
        batch = F.coalesce(F.least(cut, F.lit(number - 1)), F.lit(0)).cast("int")
    return c.select(batch.alias("batch"), "client_id", "at", "click_id"), s.select(batch.alias("batch"), "client_id", "at", "sale_id")


def watermarks(clicks: DataFrame, sales: DataFrame, number: int, lag: int) -> list[int | None]:
    """The watermark of each batch: lag before the smaller of the latest click and the latest sale of the batches before; None until there are both."""
    both = clicks.select("batch", F.lit(0).alias("kind"), "at").unionByName(sales.select("batch", F.lit(1).alias("kind"), "at"))
    latest = {(r.batch, r.kind): r.at for r in both.groupBy("batch", "kind").agg(F.max("at").alias("at")).collect()}  # two rows a batch
    out: list[int | None] = []
    seen: dict[int, int] = {}
    for k in range(number):
        out.append(min(seen.values()) - lag if len(seen) == 2 else None)
        for kind in (0, 1):
            if (k, kind) in latest:
                seen[kind] = max(seen.get(kind, latest[k, kind]), latest[k, kind])
    return out


def dealt(clicks: DataFrame, sales: DataFrame, marks: list[int | None], rules: Rules) -> DataFrame:
    """The rows of the stream (ROWS and batch), each with the cell whose state it meets.

    Clients with more rows than hot_share of all and than a cell holds are
    dealt by the hour: at most as many as the share's inverse, so that their
    list can be broadcast.
    """
    both = clicks.select("client_id").unionByName(sales.select("client_id"))
    counts = both.groupBy("client_id").agg(F.count("*").alias("rows"))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    cells = max(1, -(-total // rules.cell_rows))
    limit = max(rules.cell_rows, total * rules.hot_share)
    sold = sales.groupBy("client_id").agg(F.count("*").alias("sold"))
    hot = stored(counts.where(F.col("rows") > limit).join(sold, "client_id", "left").select("client_id", F.ceil(F.coalesce("sold", F.lit(0)) / rules.cell_rows).cast("int").alias("shares")))
    hour = lambda at: (at - F.pmod(at, F.lit(HOUR)))
    # Cells of ordinary clients are 0, 1, ...; all others are negative.
    own = lambda *key: F.xxhash64(*key).bitwiseOR(F.lit(-(2**63)))
    of_client = F.pmod(F.xxhash64("client_id"), F.lit(cells))

    def rows(df: DataFrame, kind: int, key: str, cell: Column, at: Column, n: Column, since: Column, until: Column, part: int) -> DataFrame:
        return df.select("batch", cell.alias("cell"), "client_id", F.lit(kind).alias("kind"), at.alias("at"), F.coalesce(key, F.lit(NONE)).alias("id"), n.alias("n"), since.alias("since"), until.alias("until"), F.lit(part).alias("part"))

    none, one, at = F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("at")
    since = at - rules.window
    out = [
        rows(clicks.join(F.broadcast(hot), "client_id", "left_anti"), 0, "click_id", of_client, at, one, none, none, WHOLE),
        rows(sales.join(F.broadcast(hot), "client_id", "left_anti"), 1, "sale_id", of_client, at, none, since, at, WHOLE),
    ]
    if not hot.isEmpty():
        c, s = clicks.join(F.broadcast(hot), "client_id"), sales.join(F.broadcast(hot), "client_id")
        share = lambda i: own("client_id", F.lit(-1).cast("long"), i.cast("long"))
        # A batch's clicks behind its watermark don't count, neither one by one nor in the hours' numbers.
        behind = F.lit(None).cast("long")
        for k, w in enumerate(marks):
            if w is not None:
                behind = F.when(F.col("batch") == k, F.lit(w)).otherwise(behind)
        hours = c.where(at >= F.coalesce(behind, F.lit(-END))).groupBy("batch", "client_id", "shares", hour(at).alias("hour")).agg(F.count("*").alias("count"), F.max(F.struct("at", "click_id")).alias("last"))
        hours = hours.select("batch", "client_id", F.col("last.at").alias("at"), F.col("last.click_id").alias("click_id"), "count", F.explode(F.sequence(F.lit(0), F.greatest(F.col("shares"), F.lit(1)) - 1)).alias("share"))
        out += [
            rows(c, 0, "click_id", own("client_id", hour(at)), at, one, none, none, WHOLE),
            rows(hours, 0, "click_id", share(F.col("share")), at, F.col("count"), none, none, WHOLE),
            rows(s, 1, "sale_id", own("client_id", hour(at)), at, none, hour(at), at, LAST),
            rows(s, 1, "sale_id", own("client_id", hour(since)), at, none, since, hour(since) + HOUR - 1, FIRST),
            rows(s, 1, "sale_id", share(F.pmod(F.xxhash64("sale_id", "at"), F.greatest(F.col("shares"), F.lit(1)))), at, none, hour(since) + HOUR, hour(at) - 1, BETWEEN),
        ]
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first


def _sorted(parts: list[np.ndarray], dtype: np.dtype) -> np.ndarray:
    all_ = np.concatenate([np.zeros(0, dtype=dtype), *parts])
    return all_[np.lexsort((all_["id"], all_["at"], all_["client"]))]


def last_clicks(clicks: np.ndarray, sales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sale the place of its last click in clicks, sorted by client, time and id, or -1; and the number of its clicks."""
    places, counts = np.full(len(sales), -1, dtype=np.int64), np.zeros(len(sales), dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(clicks["n"])])
    order = np.argsort(sales["client"], kind="stable")
    names, starts = np.unique(sales["client"][order], return_index=True)
    left, right = np.searchsorted(clicks["client"], names, "left"), np.searchsorted(clicks["client"], names, "right")
    for own, lo, hi in zip(np.split(order, starts[1:]), left, right, strict=True):
        if lo == hi:
            continue
        at = clicks["at"][lo:hi]
        a, b = lo + np.searchsorted(at, sales["since"][own], "left"), lo + np.searchsorted(at, sales["until"][own], "right")
        some = b > a
        places[own[some]], counts[own[some]] = b[some] - 1, (total[b] - total[a])[some]
    return places, counts


def _packed(rows: pd.DataFrame, dtype: np.dtype) -> np.ndarray:
    out = np.empty(len(rows), dtype=dtype)
    for field in dtype.names:
        out[field] = rows["client_id" if field == "client" else field]
    return out


def _nullable(x: np.ndarray, gone: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.where(gone, 0, x), gone)


def updater(batch: int, mark: int | None, window: int):
    """What a cell does in one batch; mark is the batch's watermark."""

    def answers(sales: np.ndarray, places: np.ndarray, counts: np.ndarray, clicks: np.ndarray, late: bool) -> pd.DataFrame:
        n, none = len(sales), places < 0
        pick = clicks[np.where(none, 0, places)] if len(clicks) else np.zeros(n, dtype=CLICK)
        return pd.DataFrame({
            "sale_id": _nullable(sales["id"], sales["id"] == NONE), "client_id": sales["client"], "sold_at": sales["at"], "part": sales["part"].astype(np.int32), "batch": np.full(n, batch, dtype=np.int32),
            "late": np.full(n, late), "click_at": _nullable(pick["at"], none), "click_id": _nullable(pick["id"], none | (pick["id"] == NONE)), "n_clicks": counts,
        })

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clicks, sales = (np.frombuffer(b, dtype=d) for b, d in zip(state.get, (CLICK, SALE), strict=True)) if state.exists else (np.zeros(0, dtype=CLICK), np.zeros(0, dtype=SALE))
        new_clicks, new_sales = [clicks], [sales]
        for rows in frames if not state.hasTimedOut else ():
            new_clicks.append(_packed(rows[rows["kind"] == 0], CLICK))
            new_sales.append(_packed(rows[rows["kind"] == 1], SALE))
        nothing = np.zeros(0, dtype=CLICK)
        if mark is not None:
            new_clicks[1:] = [c[c["at"] >= mark] for c in new_clicks[1:]]
            for s in new_sales[1:]:
                late = s[s["at"] < mark]
                if len(late):
                    yield answers(late, np.full(len(late), -1), np.zeros(len(late), dtype=np.int64), nothing, True)
            new_sales[1:] = [s[s["at"] >= mark] for s in new_sales[1:]]
        clicks, sales = _sorted(new_clicks, CLICK), np.concatenate(new_sales)
        if mark is not None:
            closing = sales["at"] < mark
            if closing.any():
                closed, sales = sales[closing], sales[~closing]
                yield answers(closed, *last_clicks(clicks, closed), clicks, False)
            clicks = clicks[clicks["at"] >= mark - window]
        if not len(clicks) and not len(sales):
            if state.exists:
                state.remove()
            return
        state.update((clicks.tobytes(), sales.tobytes()))
        # At the earliest sale; without one, when the last click may go.
        due = int(sales["at"].min()) if len(sales) else int(clicks["at"].max()) + window
        state.setTimeoutTimestamp(max(min(due // 1000, LATEST - 1), state.getCurrentWatermarkMs(), 1))

    return update


def attributed(clicks: DataFrame, sales: DataFrame, number: int = 8, rules: Rules = Rules()) -> DataFrame:
    """sale_id, client_id, sold_at, batch, late, click_at, click_id, n_clicks of each sale of sales (sale_id, client_id, sold_at, arrived_at) by clicks (click_id, ts, arrived_at, client_id); times in microseconds.

    The tables are dealt to `number` batches, written to a new folder of the
    shared one, and a streaming query is started on one checkpoint for each in
    turn; a last start, behind all rows, closes what is left as batch `number`.
    A sale without a client or a time has no row; repeated sales each have
    one; a click without an id is one click, and no sale names it.
    """
    spark = clicks.sparkSession
    batches(spark)
    folder = f"{scratch_dir(spark)}/attribution-{uuid.uuid4().hex}"
    clicks, sales = in_batches(clicks, sales, number)
    marks = watermarks(clicks, sales, number, rules.lag)
    # A row without a cell moves the clock in batches that have no other.
    schema = spark.createDataFrame([], f"batch int, {ROWS}").schema
    ticks = spark.createDataFrame([(k, None, 0, -1, *[0] * (len(schema) - 4)) for k in range(number + 1)], schema)
    dealt(clicks, sales, marks, rules).select(*[F.col(f.name).cast(f.dataType) for f in schema]).unionByName(ticks).write.partitionBy("batch").parquet(f"{folder}/batches")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{folder}/in"))
    clock = 0
    # Without data-free batches a batch sees the watermark of the batches before it.
    with held(spark, spark_sql_streaming_noDataMicroBatches_enabled="false", spark_sql_execution_arrow_maxRecordsPerBatch=SHORT_ROWS):
        for k, mark in enumerate([*marks, END]):
            following = marks[k + 1] if k + 1 < number else END
            clock = END_CLOCK if following == END else max(clock + 1, min(-(-(following or 0) // 1000), LATEST))
            files.rename(path(f"{folder}/batches/batch={k}"), path(f"{folder}/in/{k}"))
            rows = spark.readStream.schema(ROWS).parquet(f"{folder}/in/*").withColumn("clock", F.timestamp_millis(F.lit(clock + (k == number)))).withWatermark("clock", "0 seconds")
            found = rows.groupBy("cell").applyInPandasWithState(updater(k, mark, rules.window), FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout)
            running = found.writeStream.format("parquet").option("path", f"{folder}/found").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            running.awaitTermination()
    return together(spark.read.schema(FOUND).parquet(f"{folder}/found"))


def together(found: DataFrame) -> DataFrame:
    """A row for each sale; the three parts of a sale of a client that was dealt by the hour become one. Parts of repeated sales are alike, so their number tells how many there were."""
    whole = found.where(F.col("part") == WHOLE).drop("part")
    parts = found.where(F.col("part") != WHOLE)
    last = F.max(F.when(F.col("click_at").isNotNull(), F.struct("click_at", "click_id")))
    keys = ["sale_id", "client_id", "sold_at", "batch", "late"]
    one = parts.groupBy(*keys).agg(last.alias("last"), F.sum("n_clicks").alias("n"), F.count(F.when(F.col("part") == LAST, 1)).alias("copies"))
    each = one.select(*keys, "last.click_at", "last.click_id", (F.col("n") / F.col("copies")).cast("long").alias("n_clicks"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return whole.unionByName(each.drop("_copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the last click of each of `sales` among `clicks` of the seven days before, in 8 batches."""
    return attributed(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales")).select("sale_id", "batch", "late", "click_id", "n_clicks")


#: crc32 of a decimal id, bit by bit: for each byte its exclusive or, then eight shifts; of the inverted result only the remainder by 4 counts.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: list_prepend(CAST(ascii(x) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"""


def _oracle(number: int = 8) -> str:
    hour = lambda key: f"epoch_us(arrived_at) // {HOUR} + CASE WHEN {_CRC.format(key)} % 4 = 0 THEN 240 ELSE 0 END"
    cut = f"CAST(greatest(0, least({number - 1}, {number} * (h - lo) // (hi - lo + 1))) AS INTEGER)"
    return f"""WITH c0 AS MATERIALIZED (SELECT DISTINCT click_id, client_id, epoch_us(ts) AS us, {hour('click_id')} AS h FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
s0 AS MATERIALIZED (SELECT row_number() OVER () AS r, sale_id, client_id, epoch_us(sold_at) AS us, {hour('sale_id')} AS h FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
ends AS (SELECT min(h) AS lo, max(h) AS hi FROM c0),
c1 AS MATERIALIZED (SELECT click_id, client_id, us, {cut} AS b FROM c0, ends),
s1 AS MATERIALIZED (SELECT r, sale_id, client_id, us, {cut} AS b FROM s0, ends),
marks AS MATERIALIZED (SELECT k, CASE WHEN k = {number} THEN {END} WHEN c IS NOT NULL AND s IS NOT NULL THEN least(c, s) - {DAY} END AS w
  FROM (SELECT k, (SELECT max(us) FROM c1 WHERE b < k) AS c, (SELECT max(us) FROM s1 WHERE b < k) AS s FROM (SELECT unnest(range({number + 1})) AS k))),
c2 AS (SELECT click_id, client_id, us, b FROM c1 JOIN marks ON k = b WHERE w IS NULL OR us >= w),
s2 AS (SELECT s1.*, coalesce(us < w, false) AS late, (SELECT min(k) FROM marks n WHERE n.k >= b AND us < n.w) AS batch FROM s1 JOIN marks ON k = b)
SELECT s.sale_id, CAST(s.batch AS INTEGER) AS batch, s.late, max(struct_pack(t := c.us, i := c.click_id)).i AS click_id, count(c.us) AS n_clicks
FROM s2 s LEFT JOIN c2 c ON c.client_id = s.client_id AND NOT s.late AND c.b <= s.batch AND c.us BETWEEN s.us - {7 * DAY} AND s.us
GROUP BY s.r, s.sale_id, s.batch, s.late"""


ORACLE = _oracle()
