"""Relational store operations as views: retention, upserts, leases, staleness, pages and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def newest_per_key(df: DataFrame, by: list[str], keep: int, *order: Column) -> DataFrame:
    return ranked(df, by, *order).where(F.col("__r") <= keep).drop("__r")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Changes replace current rows by key; of several changes the first in order wins."""
    last = newest_per_key(changes, keys, 1, *order)
    return last.unionByName(current.join(last.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def cascade_delete(child: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Children whose parent is still there."""
    return child.join(parents.select(*on).distinct(), on, "left_semi")


def orphans(child: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    return child.join(parents.select(*on).distinct(), on, "left_anti")


def changed_only(df: DataFrame, by: list[str], payload: str, *order: Column) -> DataFrame:
    """Rows whose payload differs from the row just before; null equals null."""
    before = F.lag(payload).over(Window.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return df.withColumn("__new", first | ~F.col(payload).eqNullSafe(before)).where("__new").drop("__new")


def claimable(ops: DataFrame, now, *, id_col: str = "id", by: tuple[str, ...] = ("job", "kind")) -> DataFrame:
    """Queued or expired operations that no other running one of the same job and kind with a live lease excludes.

    A group's live leases are counted, so that a job with very many operations needs no pairs.
    """
    live = (F.col("status") == "running") & (F.col("lease") > now)
    busy = ops.where(live).select(*by).distinct()
    ready = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease").isNull() | (F.col("lease") <= now)))
    return ops.where(ready).join(busy, list(by), "left_anti")


def requeue_expired(ops: DataFrame, now) -> DataFrame:
    stuck = (F.col("status") == "running") & (F.col("lease").isNull() | (F.col("lease") <= now))
    return ops.withColumns({"status": F.when(stuck, "queued").otherwise(F.col("status")), "lease": F.when(~stuck, F.col("lease"))})


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """Rows of a page, with whether more follow; one row over the limit tells."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = rows.withColumn("__r", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows at most
    return numbered.withColumn("truncated", F.max("__r").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("__r") <= limit).drop("__r")


def with_counts(parent: DataFrame, child: DataFrame, on: str, name: str) -> DataFrame:
    """Rows of the parent with their number of children, 0 for none."""
    return parent.join(child.groupBy(on).agg(F.count(F.lit(1)).alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def stale(artifacts: DataFrame, sources: DataFrame, on: list[str], revision: str = "revision") -> DataFrame:
    """Artifacts with whether their source has moved on."""
    now = sources.select(*on, F.col(revision).alias("__now"))
    return artifacts.join(now, on, "left").withColumn("stale", F.coalesce(F.col("__now") > F.col(revision), F.lit(True))).drop("__now")


def compact_ids(df: DataFrame, by: list[str], *order: Column, live: str = "live", prefix: str = "r", retired: str = "x") -> DataFrame:
    """New ids: live rows r1.. in order, others with their own prefix, and the order from 0."""
    place = F.row_number().over(Window.partitionBy(*by, live).orderBy(*order))
    return df.withColumns({"new_id": F.concat(F.when(F.col(live), prefix).otherwise(retired), place.cast("string")), "new_order": (place - 1).cast("bigint")})


def stable_split(df: DataFrame, stratum: str, name: str) -> DataFrame:
    """The last name of each stratum with more than one is its holdout; a maximum, so that no stratum is sorted."""
    last = df.groupBy(stratum).agg(F.max(name).alias("__last"), F.count(F.lit(1)).alias("__n"))
    held = (F.col(name) == F.col("__last")) & (F.col("__n") > 1)
    return df.join(last, stratum, "left").withColumn("split", F.when(held, "holdout").otherwise("dev")).drop("__last", "__n")


def hash_split(c, holdout: tuple[int, ...] = (8, 9)) -> Column:
    """By the first eight bytes of a SHA-256, as an unsigned number, mod 10."""
    high = F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when((high % 10).cast("int").isin(*holdout), "holdout").otherwise("train")


def bracket_keyframes(frames: DataFrame, keys: DataFrame, on: list[str], at: str = "frame", value: str = "value") -> DataFrame:
    """Each frame with the last key at or before it and the first at or after it, by one union and two fills."""
    both = frames.select(*on, at, F.lit(None).cast("bigint").alias("__k"), F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__f")).unionByName(
        keys.select(*on, at, F.col(at).cast("bigint").alias("__k"), F.col(value).cast("double").alias("__v"), F.lit(0).alias("__f"))
    )
    # keys of a frame come before it going forward, and after it going back
    ahead = Window.partitionBy(*on).orderBy(at, "__f").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*on).orderBy(F.desc(at), "__f").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("__f") == 0, F.struct("__k", "__v"))
    out = both.withColumns({"__a": F.last(mark, True).over(ahead), "__b": F.last(mark, True).over(back)}).where("__f = 1")
    before, after, here = F.col("__a.__k"), F.col("__b.__k"), F.col(at)
    between = F.when(before == after, F.col("__a.__v")).otherwise(F.col("__a.__v") + (F.col("__b.__v") - F.col("__a.__v")) * (here - before) / F.nullif(after - before, F.lit(0)))
    return out.select(*on, at, before.alias("key_before"), after.alias("key_after"), F.coalesce(between, F.col("__a.__v"), F.col("__b.__v")).alias("value"))


def provenance(left, right, order: str = "pass") -> Column:
    """Two histories as one, by pass, null passes last."""
    both = F.concat(left, right)
    keyed = F.transform(both, lambda s: F.struct(s[order].isNull().alias("n"), s[order].alias("o"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def insert_rows(current: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """The table with new rows under the next ids, in the order of a hash of their content; ids need no common sorted task.

    Rows are dealt to buckets, a bucket's first number comes from the buckets' counts (at most 1024 rows).
    """
    last = current.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("__last"))
    own = [c for c in rows.columns if c != id_col]
    dealt = rows.select(*own).withColumn("__h", F.xxhash64(*own)).withColumn("__b", F.pmod("__h", F.lit(1024)))
    counts = dealt.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *own))
    numbered = dealt.withColumn("__p", place).join(F.broadcast(first), "__b").crossJoin(F.broadcast(last))  # 1024 rows, one row
    return current.unionByName(numbered.select((F.col("__last") + F.col("__first") + F.col("__p")).cast(current.schema[id_col].dataType).alias(id_col), *own), allowMissingColumns=True)


def append_once(current: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The table with those new rows whose key it doesn't hold; of new rows with one key only one is taken."""
    return current.unionByName(rows.dropDuplicates(on).join(current.select(*on), on, "left_anti"), allowMissingColumns=True)


def compare_and_set(current: DataFrame, changes: DataFrame, on: list[str], expected: str = "revision") -> DataFrame:
    """Rows take a change's values only where their ``expected`` column still is what the change was made from (``expected_`` before the name).

    ``applied`` tells which did; a row whose change came too late, or that has none, stays as it is.
    """
    new = [c for c in changes.columns if c not in on and c != f"expected_{expected}"]
    side = changes.select(*on, F.col(f"expected_{expected}").alias("__was"), F.struct(*new).alias("__new"))
    joined = current.join(side, on, "left").withColumn("applied", F.coalesce(F.col("__was") == F.col(expected), F.lit(False)))
    kept = [F.when(F.col("applied"), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in current.columns]
    return joined.select(*kept, "applied")


def delete_scope(df: DataFrame, scope: Column) -> DataFrame:
    """The rows outside a scope; those for which it is unknown stay."""
    return df.where(~F.coalesce(scope, F.lit(False)))


def evolve(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Missing columns are added with their type and default; those that are there keep their values."""
    return df.withColumns({name: F.lit(value).cast(kind) for name, (kind, value) in columns.items() if name not in df.columns})


def dedupe_jobs(ops: DataFrame, asked: DataFrame, on: list[str], preview: str = "preview") -> DataFrame:
    """Operations after requests came in: a request whose key is there is dropped, queued previews of a requested job and kind are superseded."""
    fresh = asked.dropDuplicates(on).join(ops.select(*on), on, "left_anti")
    over = fresh.select(*on[:2]).distinct().withColumn("__new", F.lit(True))
    stale = F.coalesce("__new", F.lit(False)) & (F.col("status") == "queued") & F.col(preview)
    kept = ops.join(over, on[:2], "left").withColumn("status", F.when(stale, "superseded").otherwise(F.col("status"))).select(*ops.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)


def memory_candidates(memory: DataFrame, project, target: str, source: str | None = None, most: int = 2000) -> DataFrame:
    """A project's records of a target language, newest first, at most ``most``; of a source language those without one too."""
    rows = memory.where((F.col("project") == project) & (F.col("target_lang") == target))
    if source is not None:
        rows = rows.where(F.col("source_lang").isNull() | (F.col("source_lang") == source))
    return rows.orderBy(F.desc("created"), F.desc("id")).limit(most)


def override_union(base: DataFrame, over: DataFrame, on: list[str]) -> DataFrame:
    """All keys of both, with the overriding table's values where it has the key."""
    return over.unionByName(base.join(over.select(*on).distinct(), on, "left_anti"), allowMissingColumns=True)


def latest_checkpoint(chunks: DataFrame, by: list[str], **wanted) -> DataFrame:
    """The newest completed chunk whose revision, dependency and fingerprint are the wanted ones."""
    usable = chunks.where(F.col("status") == "completed")
    for name, value in wanted.items():
        usable = usable.where(F.col(name).eqNullSafe(F.lit(value)))
    return newest_per_key(usable, by, 1, F.desc("chunk"), F.desc("id"))


def active_block(blocks: DataFrame, by: list[str]) -> DataFrame:
    """The first block in order that is still open."""
    return newest_per_key(blocks.where(F.col("open")), by, 1, F.asc("place"), F.asc("block"))


def rewrite_ids(references: DataFrame, mapping: DataFrame, by: list[str], on_dangling: str = "error") -> DataFrame:
    """Lists of ids (``ids``) under their new names, in their order. Mapping has old_id and new_id.

    An id that the mapping lacks fails the job (error), is left out (drop) or stays (keep).
    """
    if on_dangling not in ("error", "drop", "keep"):
        raise ValueError(f"unknown policy {on_dangling}")
    named = references.withColumn("__row", F.xxhash64(*by)).select("*", F.posexplode_outer("ids").alias("__at", "old_id"))
    joined = named.join(mapping.select(*[c for c in by if c in mapping.columns], "old_id", "new_id"), [*[c for c in by if c in mapping.columns], "old_id"], "left")
    lost = F.col("old_id").isNotNull() & F.col("new_id").isNull()
    if on_dangling == "error":
        new = F.when(lost, F.raise_error(F.concat(F.lit("no region for id "), F.col("old_id"))).cast("string")).otherwise(F.col("new_id"))
    else:
        new = F.when(lost & F.lit(on_dangling == "keep"), F.col("old_id")).otherwise(F.col("new_id"))
    parts = F.array_sort(F.collect_list(F.when(new.isNotNull(), F.struct(F.col("__at").alias("at"), new.alias("id")))))
    rest = [c for c in references.columns if c != "ids"]
    return joined.groupBy(*rest).agg(F.transform(parts, lambda p: p["id"]).alias("ids")).select(*references.columns)


def token_difference(source, target) -> Column:
    """Tokens of the source list that the target list lacks, each once, in order of the first."""
    return F.array_except(source, target)
