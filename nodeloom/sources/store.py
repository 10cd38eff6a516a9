"""Keyed tables in a shared folder: buckets rewritten one by one, versions told by manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Files


class Conflict(RuntimeError):
    """Another writer has moved on in the meantime."""


class KeyedStore:
    """One row per key, split into buckets by the key's hash.

    A change reads and writes the buckets that hold its keys; the others stay as they are. A
    version is a manifest that names the files of every bucket; it is created last and never
    overwritten, so readers see one version or the other, a failed writer leaves the one
    before, and of two writers of one version the second is refused. Older versions stay
    readable until :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, key: str, state: dict):
        self.spark, self.folder, self.schema, self.key, self.state = spark, folder, schema, key, state

    @classmethod
    def open(cls, spark: SparkSession, folder: str, schema, key: str, *, buckets: int = 16, version: int | None = None) -> KeyedStore:
        """The latest version in ``folder`` (or one that is named), or an empty store of version 0."""
        files = Files(spark)
        names = sorted((n for n in files.names(folder) if n.startswith("manifest-")), reverse=True)
        for name in names:
            try:
                state = json.loads(files.read(f"{folder}/{name}"))
            except ValueError:  # its writer was lost before the manifest was whole
                continue
            if version is None or state["version"] == version:
                return cls(spark, folder, schema, key, state)
        if version:
            raise KeyError(f"no version {version}")
        return cls(spark, folder, schema, key, {"version": 0, "buckets": buckets, "files": {}, "note": None})

    @property
    def version(self) -> int:
        return self.state["version"]

    def _read(self, buckets: list[str] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{run}/bucket={b}" for b, run in sorted(self.state["files"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def table(self) -> DataFrame:
        return self._read()

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.state["buckets"])).cast("int")

    def _touched(self, keys: DataFrame) -> list[str]:
        return [str(r[0]) for r in keys.where(F.col(self.key).isNotNull()).select(self._bucket()).distinct().collect()]

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys; only their buckets are read."""
        return self._read(self._touched(keys)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def put(self, rows: DataFrame, *, expected: int | None = None, note=None) -> KeyedStore:
        """A version in which ``rows`` replace those of their keys; a key given twice is an error."""
        keys = rows.select(self.key)
        return self._commit(keys, lambda old: old.join(keys, self.key, "left_anti").unionByName(rows.select(*old.columns)), expected, note, whole=True)

    def merge(self, rows: DataFrame, order: str, *, expected: int | None = None, note=None) -> KeyedStore:
        """A version in which each key has its row of the largest ``order``, of the old ones and ``rows``; ties fall to the larger row."""
        rest = [c for c in self.table().columns if c not in (self.key, order)]
        newest = lambda both: both.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(order, *rest)).alias("r")).select(self.key, "r.*")
        return self._commit(rows.select(self.key), lambda old: newest(old.unionByName(rows.select(*old.columns))).select(*old.columns), expected, note)

    def delete(self, keys: DataFrame, *, expected: int | None = None, note=None) -> KeyedStore:
        """A version without the rows of the given keys."""
        return self._commit(keys.select(self.key), lambda old: old.join(keys.select(self.key).distinct(), self.key, "left_anti"), expected, note)

    def _commit(self, keys: DataFrame, change, expected: int | None, note, whole: bool = False) -> KeyedStore:
        if expected is not None and expected != self.version:
            raise Conflict(f"version {self.version} is not the expected {expected}")
        touched = self._touched(keys)
        files = {b: run for b, run in self.state["files"].items() if b not in touched}
        if touched:
            run = f"run={uuid.uuid4().hex}"
            after = change(self._read(touched))
            after.withColumn("bucket", self._bucket()).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{run}")
            files |= {n.removeprefix("bucket="): run for n in Files(self.spark).names(f"{self.folder}/{run}") if n.startswith("bucket=")}
        state = {"version": self.version + 1, "buckets": self.state["buckets"], "files": files, "note": note}
        made = KeyedStore(self.spark, self.folder, self.schema, self.key, state)
        if whole and touched and made._read(touched).groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ValueError("a key was given twice")
        try:
            Files(self.spark).create(f"{self.folder}/manifest-{state['version']:012d}.json", json.dumps(state))
        except Exception as refused:
            if "exist" in str(refused).lower():
                raise Conflict(f"version {state['version']} has been written by another") from refused
            raise
        return made

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove the files that none of the last ``keep`` versions reads; returns the folders removed."""
        files = Files(self.spark)
        names = sorted(n for n in files.names(self.folder) if n.startswith("manifest-"))
        held = {run for n in names[-keep:] for run in json.loads(files.read(f"{self.folder}/{n}"))["files"].values()}
        gone = [n for n in files.names(self.folder) if n.startswith("run=") and n not in held]
        for n in [*names[:-keep], *gone]:
            files.remove(f"{self.folder}/{n}")
        return gone
