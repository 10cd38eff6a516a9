"""Incremental ingestion with Structured Streaming.

Changes arrive as files; a micro-batch is reduced to its latest record per key, compared by
digest with the published state, and only real changes rewrite the buckets that hold them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import KeyedStore


def watch(spark: SparkSession, path: str, schema, per_trigger: int = 1000, fmt: str = "parquet") -> DataFrame:
    """A folder of change records as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key in a batch."""
    rest = [c for c in changes.columns if c not in (key, order)]
    return changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, "r.*").select(*changes.columns)


def apply_changes(state: DataFrame, changes: DataFrame, key: str, order: str, deleted: str) -> DataFrame:
    """State after a batch: newer records replace older ones, deletions stay as markers.

    One aggregation over state and changes; late records older than the state do nothing.
    """
    return latest(state.unionByName(changes.select(*state.columns)), key, order)


def effective(state: DataFrame, changes: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Changes whose content differs from the state: fact-neutral ones are dropped."""
    digest = lambda: F.xxhash64(*[x for c in content for x in (F.col(c), F.col(c).isNull())])
    known = state.select(key, digest().alias("_h"))
    return changes.withColumn("_h", digest()).join(known, [key, "_h"], "left_anti").drop("_h")


class Ingest:
    """Keeps a :class:`KeyedStore` current from a stream of changes.

    A batch reads and rewrites the buckets that hold its keys. The manifest of a version
    notes the batch it holds, so a batch that is replayed after it was published does nothing.
    """

    def __init__(self, spark: SparkSession, root: str, schema, key: str, order: str, deleted: str, content: list[str], on_batch: Callable[[DataFrame, int], None] | None = None, buckets: int = 16):
        self.spark, self.root, self.schema, self.key, self.order, self.deleted, self.content, self.on_batch, self.buckets = spark, root, schema, key, order, deleted, content, on_batch, buckets

    def store(self) -> KeyedStore:
        return KeyedStore.open(self.spark, f"{self.root}/state", self.schema, self.key, buckets=self.buckets)

    def version(self) -> int:
        """The last batch that was published, -1 before any; errors of the file system are not taken for that."""
        note = self.store().state["note"]
        return -1 if note is None else note

    def state(self) -> DataFrame:
        return self.store().table()

    def batch(self, changes: DataFrame, batch_id: int) -> None:
        store = self.store()
        done = store.state["note"]
        if done is not None and batch_id <= done:
            return  # a replay of what has been published
        newest = latest(changes, self.key, self.order)
        fresh = effective(store.get(newest), newest, self.key, self.content)
        if self.on_batch:
            self.on_batch(fresh, batch_id)
        store.merge(fresh, self.order, expected=store.version, note=batch_id)

    def start(self, stream: DataFrame) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()


def reconcile(state: DataFrame, listing: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, action): what a full scan finds to differ from the state: add, update or remove.

    ``listing`` holds every key that exists now, once. The two sides meet in one aggregation;
    null contents equal each other.
    """
    digest = F.xxhash64(*[x for c in content for x in (F.col(c), F.col(c).isNull())])
    side = lambda df, m: df.select(key, digest.alias("h"), F.lit(m).alias("m"))
    both = side(state, 1).unionByName(side(listing, 2)).groupBy(key).agg(F.sum("m").alias("m"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    action = F.when(F.col("m") == 1, "remove").when(F.col("m") == 2, "add").when(F.col("lo") != F.col("hi"), "update")
    return both.select(key, action.alias("action")).where("action is not null")


def retry_delay(failures: int) -> int:
    """Seconds to wait after so many failed builds: doubling, 30 at most."""
    return 0 if failures < 1 else min(2 ** min(failures - 1, 5), 30)


def bursts(events: DataFrame, at: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Debounced batches of a stream: bursts of events per key that end after a quiet gap."""
    w = F.session_window(at, gap)
    grouped = (events.withWatermark(at, late) if events.isStreaming else events).groupBy(by, w.alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"))


#: A batch is due after so many quiet windows since its first event, and after so many microseconds at most.
WINDOWS, MOST = 5, 5_000_000


def debounced(events: DataFrame, at: str, by: str, window: int, most: int = MOST) -> DataFrame:
    """(by, first, n): batches of past events per key, closed by ``window`` quiet microseconds or by age.

    A batch takes events until none came for ``window``, or until its first event is
    ``min(5 * window, most)`` old. A key's events pass through in the order of time as one
    sorted stream, of which a task keeps one open batch. Events without a time are left out.
    """
    due = min(WINDOWS * window, most)
    kinds = dict(events.dtypes)

    def cut(batches):
        key, first, last, n = None, None, None, 0
        out: list[tuple] = []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first is not None and k == key and t - last < window and t - first < due:
                    last, n = t, n + 1
                    continue
                if first is not None:
                    out.append((key, first, n))
                key, first, last, n = k, t, t, 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.schema.field(0).type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], names=[by, "_us", "n"])
                out = []
            kind = batch.schema.field(0).type
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([first], pa.int64()), pa.array([n], pa.int64())], names=[by, "_us", "n"])

    micros = F.unix_micros(F.col(at).cast("timestamp"))
    streams = events.where(F.col(at).isNotNull()).select(by, micros.alias("_us")).repartition(by).sortWithinPartitions(by, "_us")
    return streams.mapInArrow(cut, f"`{by}` {kinds[by]}, _us bigint, n bigint").select(by, F.timestamp_micros("_us").cast(kinds[at]).alias("first"), "n")
