"""What changed between consecutive full snapshots, in one aggregation shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import canonical_json


def content_hash(df: DataFrame, columns: list[str], json_columns: tuple[str, ...] = (), json_form=canonical_json) -> F.Column:
    """64-bit hash of ``columns``; nulls hash by position, JSON columns by their canonical form."""
    parts = []
    for c in columns:
        value = json_form(F.col(c)) if c in json_columns else F.col(c)
        parts += [value, F.col(c).isNull()]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def snapshot_changes(
    snapshots: DataFrame,
    versions: DataFrame,
    *,
    scope: str = "repo",
    version: str = "version_no",
    key: str = "id",
    delivered: str = "delivered_at",
    json_columns: tuple[str, ...] = ("attributes",),
    json_form=canonical_json,
) -> DataFrame:
    """Added, removed and changed records of each version against the version listed before it.

    ``versions`` lists the delivered versions of each scope. Each snapshot row is tagged
    twice, as the current side of its own version and as the previous side of the next
    listed one; one aggregation by (scope, version, key) then takes each side's latest
    delivery and compares the two row hashes. Only hashes are shuffled, never contents.

    Returns ``(scope, version, key, change_kind)`` under the given column names.

    Defined results: rows with a null scope, version or key are ignored, as are versions
    that are not listed; among deliveries of one record the latest ``delivered`` counts (a
    null one is the oldest; ties fall to the larger hash); columns other than scope,
    version, key and ``delivered`` all count as content, those of ``json_columns`` by what
    ``json_form`` makes of them; empty tables give no rows.
    """
    content = sorted(c for c in snapshots.columns if c not in (scope, version, key, delivered))
    ordered = versions.select(F.col(scope).alias("s"), F.col(version).alias("n")).where("s is not null and n is not null").distinct()
    by = Window.partitionBy("s").orderBy("n")
    ordered = ordered.select("s", "n", F.lag("n").over(by).alias("before"), F.lead("n").over(by).alias("after"))
    rows = snapshots.where(F.col(key).isNotNull()).select(F.col(scope).alias("s"), F.col(version).alias("n"), F.col(key).alias("k"), F.struct(F.col(delivered).alias("at"), content_hash(snapshots, content, json_columns, json_form).alias("h")).alias("row"))
    side = F.explode(
        F.filter(
            F.array(
                F.struct(F.when(F.col("before").isNotNull(), F.col("n")).alias("n"), F.lit(True).alias("current")),
                F.struct(F.col("after").alias("n"), F.lit(False).alias("current")),
            ),
            lambda x: x["n"].isNotNull(),
        )
    )
    tagged = rows.join(ordered, ["s", "n"]).select("s", "k", "row", side.alias("side"))
    sides = tagged.groupBy("s", F.col("side.n").alias("n"), "k").agg(
        F.max(F.when(F.col("side.current"), F.col("row"))).alias("new"),
        F.max(F.when(~F.col("side.current"), F.col("row"))).alias("old"),
    )
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old.h") != F.col("new.h"), "changed")
    return sides.select(F.col("s").alias(scope), F.col("n").alias(version), F.col("k").alias(key), kind.alias("change_kind")).where("change_kind is not null")


def change_counts(changes: DataFrame, *by: str) -> DataFrame:
    """Exact counts of added, removed and changed records per group."""
    return changes.groupBy(*by).agg(*[F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "removed", "changed")])
