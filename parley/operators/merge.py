"""Table maintenance as pure functions: the result table after an upsert, a tombstone, an ingest or a consolidation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of source replace those of target with the same keys; others stay."""
    return target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(source)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of source whose keys target does not have are added."""
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti").select(*source.columns))


def upsert_counter(state: DataFrame, changes: DataFrame, keys: Sequence[str], counter: str = "generation") -> DataFrame:
    """Every change raises its key's counter by one; new keys start at their number of changes."""
    both = state.select(*keys, counter).unionByName(changes.select(*keys, F.lit(1).cast("long").alias(counter)))
    return both.groupBy(*keys).agg(F.sum(counter).alias(counter))


def upsert_where(target: DataFrame, source: DataFrame, keys: Sequence[str], replaceable: Column) -> DataFrame:
    """As upsert, but a row of target that is not `replaceable` stays and its source row is ignored."""
    fixed = target.where(~replaceable)
    return upsert(target, source.join(fixed.select(*keys), list(keys), "left_anti").select(*source.columns), keys)


def update_from_map(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """column takes mapping's `winner` where it is a `loser`; Spark broadcasts the map where its size allows."""
    m = mapping.select(F.col("loser").alias(column), F.col("winner").alias("_winner"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_winner", column)).select(*df.columns)


def canonical_map(df: DataFrame, key: str, same: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """(loser, winner): rows alike in `same` are one; the first in a total order is kept."""
    w = Window.partitionBy(*same).orderBy(*order)
    ranked = df.select(F.col(key).alias("loser"), F.first(key).over(w).alias("winner"))
    return ranked.where(F.col("loser") != F.col("winner"))


def tombstone(df: DataFrame, where: Column, stamp: str, deleted_at: str = "deleted_at") -> DataFrame:
    """Active rows that `where` picks are soft-deleted with a stamp."""
    return df.withColumn(deleted_at, F.when(F.col(deleted_at).isNull() & where, F.lit(stamp)).otherwise(F.col(deleted_at)))


def restore(df: DataFrame, stamp: str, deleted_at: str = "deleted_at") -> DataFrame:
    """Rows that one tombstone deleted come back; others stay deleted."""
    return df.withColumn(deleted_at, F.when(F.col(deleted_at) == stamp, F.lit(None).cast("string")).otherwise(F.col(deleted_at)))


def compare_and_set(df: DataFrame, changes: DataFrame, key: str, version: str, values: Sequence[str]) -> DataFrame:
    """Changes (key, version, values) apply only to rows that still have that version, which then rises by one."""
    new = changes.select(key, F.col(version).alias("_expected"), *[F.col(v).alias(f"_{v}") for v in values])
    hit = F.col("_expected") == F.col(version)
    out = df.join(new, key, "left")
    out = out.withColumns({v: F.when(hit, F.col(f"_{v}")).otherwise(F.col(v)) for v in values} | {version: F.when(hit, F.col(version) + 1).otherwise(F.col(version))})
    return out.select(*df.columns)


def fill_gap(df: DataFrame, same: Sequence[str], column: str, newest: Sequence[str]) -> DataFrame:
    """Where column is empty it takes the value of the newest row alike in `same` that has one."""
    value = F.nullif(F.col(column), F.lit(""))
    twin = df.where(value.isNotNull()).groupBy(*same).agg(F.max_by(column, F.struct(*newest)).alias("_twin"))
    return df.join(twin, list(same), "left").withColumn(column, F.coalesce(value, "_twin", column)).select(*df.columns)


def ingest_outcomes(envelopes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """What a sequence of envelopes (key, source_id, revision, finalized, content_hash) does to its key, an outcome for each.

    applied: a higher revision of the key's source; already: the revision and
    content that stand; conflict: that revision with other content; stale: a
    lower revision; foreign: another source than the key's first; final: any
    change after a finalized one. What stands is the highest revision before,
    first of equals, so a window over each key decides.
    """
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("source_id") == F.coalesce(F.first("source_id").over(before), F.col("source_id"))
    rows = envelopes.withColumn("_own", own)
    rows = rows.withColumn("_done", F.coalesce(F.max(F.col("finalized") & F.col("_own")).over(before), F.lit(False)))
    counts = F.col("_own") & ~F.col("_done")  # nothing changes what a finalized envelope left
    rows = rows.withColumn("_top", F.max(F.when(counts, F.col("revision"))).over(before))
    first = F.struct(F.col("revision"), *[(-F.col(o).cast("long")).alias(f"n{i}") for i, o in enumerate(order)])
    rows = rows.withColumn("_hash", F.max_by("content_hash", F.when(counts, first)).over(before))
    same = (F.col("revision") == F.col("_top")) & (F.col("content_hash") == F.col("_hash"))
    outcome = (
        F.when(~F.col("_own"), "foreign").when(F.col("_top").isNull(), "applied").when(same, "already").when(F.col("_done"), "final")
        .when(F.col("revision") == F.col("_top"), "conflict").when(F.col("revision") < F.col("_top"), "stale").otherwise("applied")
    )
    return rows.withColumn("outcome", outcome).drop("_own", "_top", "_hash", "_done")


def reconcile(children: DataFrame, incoming: DataFrame, keys: Sequence[str], marker: str, source: str, stamp: str) -> DataFrame:
    """Children that the new envelope lacks are tombstoned, but only those that the same source had made."""
    here = incoming.select(*keys).withColumn("_here", F.lit(True))
    gone = F.col("_here").isNull() & (F.col(marker) == source)
    return tombstone(children.join(here, list(keys), "left"), gone, stamp).select(*children.columns)


def import_outcomes(target: DataFrame, items: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, outcome) of a dry run: imported where the key is new, matched where the row is equal, filled where only gaps differ, conflict otherwise."""
    t = target.select(key, F.lit(True).alias("_in"), *[F.col(v).alias(f"_t_{v}") for v in values])
    j = items.join(t, key, "left")
    pairs = [(F.col(v).cast("string"), F.col(f"_t_{v}").cast("string")) for v in values]
    equal = F.lit(True)
    gap = F.lit(True)
    for a, b in pairs:
        equal &= a.eqNullSafe(b)
        gap &= a.eqNullSafe(b) | b.isNull() | (b == "")
    return j.select(key, F.when(F.col("_in").isNull(), "imported").when(equal, "matched").when(gap, "filled").otherwise("conflict").alias("outcome"))


def unchanged(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items that were completed before with the same path, hash and importer version: those that a run skips."""
    return items.join(done.select(*keys).distinct(), list(keys), "left_semi")


def replace_set(rows: DataFrame, incoming: DataFrame, key: str, belongs: Column, stamp: str) -> DataFrame:
    """The set of one source becomes `incoming`: its active rows that are not there are tombstoned, the rest upserted."""
    kept = incoming.select(F.col(key), F.lit(True).alias("_kept"))
    marked = tombstone(rows.join(kept, key, "left"), belongs & F.col("_kept").isNull(), stamp).select(*rows.columns)
    return upsert(marked, incoming, [key])


def merge_entities(mappings: DataFrame, entity: str, scope: str, primary: str, duplicate: str) -> DataFrame:
    """Mappings of a duplicate move to the primary; where the primary already is in that scope, the duplicate's mapping goes."""
    has = mappings.where(F.col(entity) == primary).select(scope).distinct()
    moved = mappings.where(F.col(entity) == duplicate).join(has, scope, "left_anti").withColumn(entity, F.lit(primary)).select(*mappings.columns)
    return mappings.where(F.col(entity) != duplicate).unionByName(moved)


def expire(rows: DataFrame, expires_at: str, now: Column, stamp: str) -> DataFrame:
    """First phase of expiry: what is due is tombstoned; a later purge deletes tombstones."""
    return tombstone(rows, F.col(expires_at) <= now, stamp)


def append_once(target: DataFrame, rows: DataFrame, identity: Sequence[str], prefix: str) -> DataFrame:
    """Appends rows under an id that hashes their identity; rows that are there already, or repeat, are added once."""
    key = F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]), 256))
    new = rows.withColumn("id", key).dropDuplicates(["id"])
    return target.unionByName(new.join(target.select("id"), "id", "left_anti").select(*target.columns))
