"""Deduplication of clicks in windows that close on punctuation, as a restartable stateful stream.

Rows come in numbered batches. Per key the first row opens a window at its hour;
rows up to `hold` hours past that start are repeats, whatever their order; a
later one closes the window and opens the next. Rows more than `late` hours
behind the largest hour of earlier batches are dropped. After a batch a control
row in every bucket carries that largest hour: transformWithState takes a
bucket's data first, then scans its MapState and closes what can't grow any
more. There is no watermark and no timer.

Keys are dealt to buckets, whose number follows the rows; a bucket's open
windows lie in MapState by start hour, so that closing removes whole entries.
Rows of one batch, key, hour and hash are counted before they are shuffled to
their bucket; what is left of a key with very many rows is folded by hour, see
`folded`, so that no key brings more rows to a bucket than there are hours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampNTZType

from catlas.storage import remove

from .common import materialize, shared_dir

#: Rows that one bucket gets in all batches together, about.
ROWS_A_BUCKET = 100_000
#: A key with more counted rows than this is folded by hour.
HOT_ROWS = 10_000
#: Kinds of rows: counted data, parts of folded rows, punctuation.
DATA, PART, CONTROL = 0, 1, 2
#: An hour after all others.
END = 1 << 60
#: transformWithState needs this store; change logs are smaller than a snapshot of each bucket's files at each batch.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A query takes one batch, so an open store has no second use; closed, it gives its local files back.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

FED = "bucket int, mark int, unknown boolean, id long, hour long, hash binary, n long, mixed boolean, crc long, batch int"
CLOSED = "unknown boolean, id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
#: An open window in MapState, beside its start hour.
KEPT = np.dtype([("unknown", "?"), ("id", "<i8"), ("repeats", "<i8"), ("conflicts", "<i8"), ("crc", "<i8"), ("hash", "V32")])


def crc_of(digest: bytes) -> int:
    return zlib.crc32(digest.hex().encode())


def micros(moment: Column, zoneless: bool) -> Column:
    """Microseconds since 1970 in UTC; a timestamp without zone is taken as UTC whatever the session's zone."""
    if not zoneless:
        return F.unix_micros(moment)
    days = F.datediff(F.to_date(moment), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(moment)) * 3600 + F.minute(moment) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), moment) * 1_000_000).cast("long")


def copies(clicks: DataFrame, batches: int = 10) -> DataFrame:
    """batch, click_id, hour, hash (32 bytes) of every copy of every click, in no order.

    A click has click_id % 3 copies beside its first (none if that is null or
    negative), each some hours later and dealt to one of `batches` batches. Rows
    without arrived_at have no hour and no batch and are left out. Repeated rows
    are rows of their own. An empty table has no copies.
    """
    kinds = {f.name: isinstance(f.dataType, TimestampNTZType) for f in clicks.schema.fields}
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = clicks.select(
        "click_id",
        F.floor(micros(F.col("arrived_at"), kinds["arrived_at"]) / F.lit(3_600_000_000)).alias("arrived"),
        F.concat_ws("|", text(F.col("client_id")), text(F.col("kind")), text(F.floor(F.lit(100) * F.col("value") + F.lit(0.5))), text(micros(F.col("ts"), kinds["ts"])), text(F.col("props"))).alias("said"),
    ).filter("arrived is not null")
    each = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.coalesce(F.col("click_id") % 3, F.lit(0)), F.lit(0)).cast("long"))))
    each = each.withColumn("c", F.crc32(F.concat_ws(":", text(F.col("click_id")), F.col("j").cast("string")).cast("binary")))
    hour = F.col("arrived") + 6 * F.col("j") * (F.col("c") % 10)
    each = each.select("click_id", hour.alias("hour"), (hour + F.floor(F.col("c") / 10).cast("long") % 200).alias("dealt"), "said", "c")
    ends = each.agg(F.min("dealt").alias("low"), F.max("dealt").alias("high")).first()
    low, high = (ends["low"], ends["high"]) if ends["low"] is not None else (0, 0)
    batch = F.floor((F.col("dealt") - F.lit(low)) * batches / F.lit(high - low + 1)).cast("int")
    said = F.concat_ws("|", F.col("said"), (F.col("c") % 3).cast("string"))
    return each.select(batch.alias("batch"), "click_id", "hour", F.unhex(F.sha2(said.cast("binary"), 256)).alias("hash"))


def counted(rows: DataFrame, key: str) -> DataFrame:
    """Rows of one batch, key, hour and hash as one with their number; partly counted before they are shuffled."""
    unknown = F.col(key).isNull()
    rows = rows.select("batch", unknown.alias("unknown"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.col("hour").cast("long").alias("hour"), "hash")
    counts = rows.groupBy("batch", "unknown", "id", "hour", "hash").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({"mark": F.lit(DATA), "mixed": F.lit(False), "crc": F.lit(0).cast("long")})


def folded(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """`rows` with those of `hot` keys folded to one per batch, key and hour.

    A folded row has its hour's least hash, number and sum of crc. Only hashes
    that lead some hour of their key can open a window, so the hour's numbers of
    those alone come along as PART rows; both are bounded by hours, not by rows.
    """
    key, cell = ["unknown", "id"], ["batch", "unknown", "id", "hour"]
    cold, many = rows.join(hot, key, "left_anti"), materialize(rows.join(hot, key, "left_semi"), "hot-rows")
    crc = F.crc32(F.lower(F.hex("hash")).cast("binary"))
    cells = materialize(many.groupBy(*cell).agg(F.min("hash").alias("hash"), F.max("hash").alias("last"), F.sum("n").alias("n"), F.sum(F.col("n") * crc).alias("crc")), "hot-cells")
    leads = cells.select(*key, "hash").distinct()
    mixed = F.col("hash") != F.col("last")
    parts = many.join(leads, [*key, "hash"], "left_semi").withColumn("mark", F.lit(PART))
    return cold.unionByName(cells.withColumns({"mark": F.lit(DATA), "mixed": mixed}).drop("last")).unionByName(parts)


class Windows(StatefulProcessor):
    """A bucket's open windows by start hour; data first, then punctuation."""

    def __init__(self, hold: int, late: int) -> None:
        self.hold, self.late = hold, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("open", "start_hour long", "windows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stored = {start: bytes(packed) for (start,), (packed,) in self.kept.iterator()}
        windows: dict[tuple[bool, int], list] = {}  # (unknown, id): start, repeats, conflicts, crc, hash
        for start, packed in stored.items():
            for unknown, ident, *rest, digest in np.frombuffer(packed, KEPT).tolist():
                windows[unknown, ident] = [start, *rest, bytes(digest)]
        every = pd.concat(rows, ignore_index=True)
        closed: list[tuple] = []
        self._take(every, windows, closed)
        for upto, batch in every.loc[every["mark"] == CONTROL, ["hour", "batch"]].sort_values("batch").itertuples(index=False):
            for name in [k for k, w in windows.items() if w[0] + self.hold < upto - self.late]:
                closed.append((*name, batch, *windows.pop(name)))
        self._store(windows, stored)
        if closed:
            yield pd.DataFrame([(u, i, start, batch, *rest) for u, i, batch, start, *rest in closed], columns=[c.split()[0] for c in CLOSED.split(", ")])

    def _take(self, every: pd.DataFrame, windows: dict, closed: list) -> None:
        parts: dict[tuple, dict[bytes, int]] = {}
        for u, i, hour, digest, n, batch in every.loc[every["mark"] == PART, ["unknown", "id", "hour", "hash", "n", "batch"]].itertuples(index=False, name=None):
            parts.setdefault((batch, u, i, hour), {})[bytes(digest)] = n
        data = every.loc[every["mark"] == DATA]
        columns = [data[c].tolist() for c in ("batch", "unknown", "id", "hour", "hash", "n", "mixed", "crc")]
        for batch, unknown, ident, hour, digest, n, mixed, crc in sorted(zip(*columns, strict=True), key=lambda r: r[:5]):
            name = (unknown, ident)
            window = windows.get(name)
            if window is not None and hour > window[0] + self.hold:
                closed.append((*name, batch, *windows.pop(name)))
                window = None
            if window is None:
                windows[name] = window = [hour, -1, 0, 0, bytes(digest)]  # its opener is no repeat
            opener = window[4]
            window[1] += n
            if mixed:
                same = parts.get((batch, unknown, ident, hour), {}).get(opener, 0)
                window[2] += n - same
                window[3] += crc - same * crc_of(opener)
            elif digest != opener:
                window[2] += n
                window[3] += crc if crc else n * crc_of(digest)

    def _store(self, windows: dict, stored: dict[int, bytes]) -> None:
        by_start: dict[int, list[tuple]] = {}
        for name, (start, *rest, digest) in sorted(windows.items()):
            by_start.setdefault(start, []).append((*name, *rest, digest))
        for start, listed in by_start.items():
            packed = np.array(listed, KEPT).tobytes()
            if stored.pop(start, None) != packed:
                self.kept.updateValue((start,), (packed,))
        for start in stored:
            self.kept.removeKey((start,))

    def close(self) -> None:
        pass


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"can't move {source} to {target}")


def deduplicate(rows: DataFrame, batches: int, key: str = "click_id", hold: int = 48, late: int = 24, rows_a_bucket: int = ROWS_A_BUCKET, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per window: key, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash (lower-case hex).

    `rows` has batch (0 to batches - 1), the key, hour and hash (32 bytes); other
    columns are not read. Within a batch and key, order is by hour, then hash. Rows
    are counted, written by batch under spark.checkpoint.dir and fed batch by batch
    to a query that is started anew for each on one checkpoint; a batch without
    rows is its control rows alone. Null is a key like any other. Rows with a null
    batch, hour or hash must not come. An empty table gives no windows.
    """
    spark = rows.sparkSession
    base = shared_dir(spark)
    counted(rows, key).write.partitionBy("batch").parquet(f"{base}/counted")
    fields = FED.replace("bucket int, ", "")
    staged = spark.read.schema(fields).parquet(f"{base}/counted")
    hours = {r["batch"]: (r["hour"], r["n"]) for r in staged.groupBy("batch").agg(F.max("hour").alias("hour"), F.count(F.lit(1)).alias("n")).collect()}
    if not hours:
        return _named(spark.createDataFrame([], CLOSED), key)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(n for _, n in hours.values()) // rows_a_bucket + 1)
    upto = [max(h for b, (h, _) in hours.items() if b < k) if k and min(hours) < k else None for k in range(batches)]  # M of each batch
    hot = materialize(staged.groupBy("unknown", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select("unknown", "id"), "hot")
    ready = f"{base}/counted"
    if not hot.isEmpty():
        ready = f"{base}/folded"
        folded(staged, hot).write.partitionBy("batch").parquet(ready)
    control = spark.range(buckets * batches).select(F.floor(F.col("id") / batches).alias("at"), (F.col("id") % batches).cast("int").alias("batch"))
    after = F.array(*[F.lit(m if m is not None else -END).cast("long") for m in upto[1:]], F.lit(END).cast("long"))
    none = {"mark": CONTROL, "unknown": False, "n": 0, "mixed": False, "crc": 0}
    control = control.select(*[F.lit(v).cast(_kind(c)).alias(c) for c, v in none.items()], F.col("at").cast("long").alias("id"), F.element_at(after, F.col("batch") + 1).alias("hour"), F.lit(b"").alias("hash"), "batch")
    control.coalesce(1 + buckets // 10_000).write.mode("append").partitionBy("batch").parquet(ready)
    bucket = F.when(F.col("mark") == CONTROL, F.col("id")).otherwise(F.pmod(F.xxhash64("unknown", "id"), F.lit(buckets))).cast("int")
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        for k in range(batches):
            _move(spark, f"{ready}/batch={k}", f"{base}/in/batch={k}")
            fed = spark.readStream.schema(fields).parquet(f"{base}/in")
            if upto[k] is not None:
                fed = fed.filter((F.col("mark") == CONTROL) | (F.col("hour") >= upto[k] - late))
            closed = fed.select(bucket.alias("bucket"), "*").groupBy("bucket").transformWithStateInPandas(Windows(hold, late), CLOSED, "Append", "None")
            query = closed.writeStream.format("parquet").option("path", f"{base}/closed").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            remove(spark, f"{base}/in/batch={k}")  # its offsets are committed
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return _named(spark.read.schema(CLOSED).parquet(f"{base}/closed"), key)


def _kind(column: str) -> str:
    return dict(c.split() for c in FED.split(", "))[column]


def _named(closed: DataFrame, key: str) -> DataFrame:
    return closed.select(F.when(~F.col("unknown"), F.col("id")).alias(key), "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", F.lower(F.hex("hash")).alias("hash"))
