"""References to records that do not exist: an incremental, persistent ledger of orphans.

The ledger keeps keyed state in a folder: the parent index (when a key first arrived, when
it was first deleted) and the references by their present verdict, pending or resolved. All
of it is split into buckets by key. A delivery is applied as a set: new references probe the
index, arriving parents resolve the orphans that wait for them, deletions reopen resolved
ones. Only the buckets that hold a key of the delivery are read and written again; the rest
stay as they are. Every delivery adds a row set of snapshot counts. Applying deliveries in
any split gives the verdicts of one full load.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Files, Workspace

REF = ["ref_table", "ref_field", "row_id", "ref_month"]
REF_SCHEMA = "ref_table string, ref_field string, row_id string, ref_month string, space string, key string, seen_at timestamp_ntz, since timestamp_ntz, reason string"
INDEX_SCHEMA = "space string, key string, first_at timestamp_ntz, gone_at timestamp_ntz"
REPORT_SCHEMA = "ref_table string, ref_field string, ref_month string, reason string, n bigint"
PENDING, RESOLVED = "pending", "resolved"


class OrphanLedger:
    """The state of the ledger after a number of deliveries, kept in a folder.

    ``buckets`` is fixed when a ledger begins: large enough that a usual delivery touches few
    of them. Buckets are written as new generations; the manifest of a delivery, created last
    and never overwritten, says which generation of each bucket counts. A delivery that fails
    leaves the state before it, and of two writers of one delivery the second is refused.
    """

    def __init__(self, spark, folder: str, state: dict):
        self.spark, self.folder, self.state = spark, folder, state

    @classmethod
    def empty(cls, spark, buckets: int = 16) -> OrphanLedger:
        """A ledger in a folder that is removed with the session."""
        return cls.open(spark, Workspace(spark, "orphans").root, buckets)

    @classmethod
    def open(cls, spark, folder: str, buckets: int = 16) -> OrphanLedger:
        """The latest state found in ``folder``, or a new ledger."""
        files = Files(spark)
        for name in sorted((n for n in files.names(folder) if n.startswith("manifest-")), reverse=True):
            try:
                return cls(spark, folder, json.loads(files.read(f"{folder}/{name}")))
            except ValueError:  # its writer was lost before the manifest was whole
                continue
        return cls(spark, folder, {"delivery": 0, "buckets": buckets, "index": {}, PENDING: {}, RESOLVED: {}, "reports": []})

    def advance(self, references: DataFrame, parents: DataFrame) -> OrphanLedger:
        """Apply one delivery, write the buckets it touches and return the new state.

        ``references(ref_table, ref_field, row_id, ref_month, space, key, seen_at, since)``:
        one row per delivered reference; ``space`` names the set of keys it points into,
        ``seen_at`` is when the reference was observed (null: deletion and lateness do not
        apply), ``since`` when it first arrived. ``parents(space, key, first_at, gone_at)``:
        arrivals (``first_at``) and deletions (``gone_at``) of keys. Both may be empty.

        Defined results: rows with a null key are no references; a reference delivered again
        stands in the state once; repeated deliveries keep the earliest ``seen_at``,
        ``since``, ``first_at`` and ``gone_at``; an empty string is an ordinary key.
        """
        n = self.state["delivery"] + 1
        run = f"delivery={n}/run={uuid.uuid4().hex}"  # two writers of one delivery do not meet
        bucket = F.pmod(F.xxhash64("space", "key"), F.lit(self.state["buckets"])).cast("int")
        new = references.where("key is not null").select(*REF, "space", "key", "seen_at", "since")
        fresh = parents.where("key is not null").select("space", "key", "first_at", "gone_at")
        known = bool(self.state["index"] or self.state[PENDING] or self.state[RESOLVED])
        touched = [r[0] for r in new.select(bucket).union(fresh.select(bucket)).distinct().collect()] if known else None
        old_index, old_refs = self._index(touched), self._references(touched, PENDING, RESOLVED)
        index = old_index.unionByName(fresh) if known else fresh
        index = index.groupBy("space", "key").agg(F.min("first_at").alias("first_at"), F.min("gone_at").alias("gone_at"))
        index = self._write(index.withColumn("bucket", bucket), f"index/{run}", "bucket")
        asked = old_refs.drop("reason").unionByName(new) if known else new
        asked = asked.groupBy(*REF, "space", "key").agg(F.min("seen_at").alias("seen_at"), F.min("since").alias("since"))
        verdict = F.when(F.col("first_at").isNull() & F.col("gone_at").isNull(), "missing").when(F.col("gone_at") <= F.col("seen_at"), "deleted").when(F.col("first_at") > F.col("since"), "late")
        arrived = self._at(dict.fromkeys(index, run), "index", INDEX_SCHEMA)
        judged = asked.join(arrived, ["space", "key"], "left").select(*REF, "space", "key", "seen_at", "since", verdict.alias("reason"))
        self._write(judged.withColumns({"state": F.when(F.col("reason").isNull(), RESOLVED).otherwise(PENDING), "bucket": bucket}), f"references/{run}", "state", "bucket")
        after = {"delivery": n, "buckets": self.state["buckets"], "index": self.state["index"] | dict.fromkeys(index, run), "reports": [*self.state["reports"], run]}
        for state in (PENDING, RESOLVED):
            kept = {b: g for b, g in self.state[state].items() if touched is not None and int(b) not in touched}
            after[state] = kept | dict.fromkeys(self._written(f"references/{run}/state={state}"), run)
        ledger = OrphanLedger(self.spark, self.folder, after)
        ledger.report().write.mode("overwrite").parquet(f"{self.folder}/reports/{run}")
        Files(self.spark).create(f"{self.folder}/manifest-{n:09d}.json", json.dumps(after))
        return ledger

    def _write(self, df: DataFrame, where: str, *by: str) -> list[str]:
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.folder}/{where}")
        return self._written(where)

    def _written(self, where: str) -> list[str]:
        return [n.removeprefix("bucket=") for n in Files(self.spark).names(f"{self.folder}/{where}") if n.startswith("bucket=")]

    def _at(self, buckets: dict, where: str, schema: str, state: str = "") -> DataFrame:
        paths = [f"{self.folder}/{where}/{g}/{state}bucket={b}" for b, g in sorted(buckets.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _index(self, touched: list[int] | None) -> DataFrame:
        return self._at({b: g for b, g in self.state["index"].items() if touched is None or int(b) in touched}, "index", INDEX_SCHEMA)

    def _references(self, touched: list[int] | None, *states: str) -> DataFrame:
        parts = [self._at({b: g for b, g in self.state[s].items() if touched is None or int(b) in touched}, "references", REF_SCHEMA, f"state={s}/") for s in states]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def orphans(self) -> DataFrame:
        """The references now pending: (ref_table, ref_field, row_id, reason, ref_month)."""
        return self._references(None, PENDING).select("ref_table", "ref_field", "row_id", "reason", "ref_month").distinct()

    def report(self) -> DataFrame:
        """Snapshot counts per table, field, month and reason."""
        return self.orphans().groupBy("ref_table", "ref_field", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n"))

    def history(self) -> DataFrame:
        """The snapshot counts after each delivery: (delivery, ref_table, ref_field, ref_month, reason, n)."""
        if not self.state["delivery"]:
            return self.spark.createDataFrame([], "delivery int, " + REPORT_SCHEMA)
        got = self.spark.read.option("basePath", f"{self.folder}/reports").schema(REPORT_SCHEMA + ", delivery int").parquet(*[f"{self.folder}/reports/{run}" for run in self.state["reports"]])
        return got.select("delivery", "ref_table", "ref_field", "ref_month", "reason", "n")


def _ends(df: DataFrame, table: str, *cols) -> DataFrame:
    end = lambda f: F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("key"))
    return df.select(F.lit(table).alias("ref_table"), F.col("id").alias("row_id"), *cols, F.explode(F.array(end("source"), end("target"))).alias("e")).select("*", "e.*").drop("e")


def _space(*cols) -> F.Column:
    return F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))


def link_references(links: DataFrame) -> DataFrame:
    """References of graph links: both ends, judged against the live node space."""
    return _ends(links, "graph_links", F.date_format("observed_at", "yyyy-MM").alias("ref_month"), F.col("observed_at").alias("seen_at"), F.col("ingested_at").alias("since")).withColumn("space", F.lit("live"))


def snapshot_references(links: DataFrame, versions: DataFrame) -> DataFrame:
    """References inside delivered versions: each judged against that version's own nodes."""
    captured = versions.groupBy("repo", "version_no").agg(F.date_format(F.min("captured_at"), "yyyy-MM").alias("ref_month"))
    known = links.join(captured, ["repo", "version_no"], "left")
    none = F.lit(None).cast("timestamp_ntz")
    return _ends(known, "snapshot_links", "ref_month", none.alias("seen_at"), none.alias("since"), _space("repo", "version_no").alias("space"))


def parent_events(nodes: DataFrame, shared: DataFrame, snapshot_nodes: DataFrame) -> DataFrame:
    """Arrivals and deletions of every key that a reference may name."""
    none = F.lit(None).cast("timestamp_ntz")
    live = nodes.select(F.lit("live").alias("space"), F.col("id").alias("key"), F.col("ingested_at").alias("first_at"), F.col("deleted_at").alias("gone_at"))
    builtin = shared.select(F.lit("live").alias("space"), F.col("id").alias("key"), F.col("ingested_at").alias("first_at"), none.alias("gone_at"))
    versioned = snapshot_nodes.select(_space("repo", "version_no").alias("space"), F.col("id").alias("key"), F.col("delivered_at").alias("first_at"), none.alias("gone_at"))
    return live.unionByName(builtin).unionByName(versioned)


def _between(df: DataFrame, at: str, lo, hi) -> DataFrame:
    """Rows that arrived in [lo, hi); a null arrival belongs to the first delivery."""
    if lo is not None:
        df = df.where(F.col(at) >= F.lit(lo).cast("timestamp_ntz"))
    if hi is not None:
        df = df.where(F.col(at).isNull() | (F.col(at) < F.lit(hi).cast("timestamp_ntz")))
    return df


def ledger_of(links, nodes, shared, snapshot_links, snapshot_nodes, versions, cuts: tuple = (), buckets: int = 16) -> OrphanLedger:
    """The ledger after delivering all tables in ``len(cuts) + 1`` steps split by arrival time."""
    ledger = OrphanLedger.empty(links.sparkSession, buckets)
    edges = [None, *sorted(cuts), None]
    for lo, hi in zip(edges, edges[1:]):
        references = link_references(_between(links, "ingested_at", lo, hi)).unionByName(snapshot_references(_between(snapshot_links, "delivered_at", lo, hi), versions))
        parents = parent_events(_between(nodes, "ingested_at", lo, hi), _between(shared, "ingested_at", lo, hi), _between(snapshot_nodes, "delivered_at", lo, hi))
        ledger = ledger.advance(references, parents)
    return ledger


def buckets_for(rows: int, each: int = 1_000_000) -> int:
    """Buckets of about ``each`` references, so that small ledgers do not write many small files."""
    return min(4096, max(4, -(-rows // each)))


def middle_of(links: DataFrame) -> tuple:
    """One cut halfway through the arrival times of ``links`` (none if there are none)."""
    lo, hi = links.agg(F.min("ingested_at"), F.max("ingested_at")).first()
    return () if lo is None or lo == hi else (lo + (hi - lo) / 2,)
