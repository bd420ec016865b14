"""Idempotent ingestion: classified upserts, cursors, queues; see `state` for what streams remember by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import backoff_seconds, ladder
from ..operators.analytics import first_per_key


def classify_upsert(new: DataFrame, old: DataFrame, key: str, content: str, identity: list[str], skip: Column | None = None) -> DataFrame:
    """new with `outcome`: Created, Changed (other content), IdentityUpdated (other identity columns), Refreshed, or Skipped.

    new has one row per key (see newest); `skip` marks target rows that refuse changes, over the columns of old
    prefixed old_.
    """
    o = old.select(*[F.col(c).alias(f"old_{c}") for c in old.columns])
    moved = F.lit(False)
    for c in identity:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    rules = [(F.col(f"old_{key}").isNull(), "Created")]
    if skip is not None:
        rules.append((skip, "Skipped"))
    rules += [(~F.col(content).eqNullSafe(F.col(f"old_{content}")), "Changed"), (moved, "IdentityUpdated")]
    joined = new.join(o, F.col(key) == F.col(f"old_{key}"), "left")
    return joined.withColumn("outcome", ladder(rules, "Refreshed")).select(*new.columns, "outcome")


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key of a load: the newest."""
    return first_per_key(rows, key, order)


def merged(target: DataFrame, changes: DataFrame, key: list[str], delete: str | None = None) -> DataFrame:
    """target after changes: matched rows replaced, new ones added, rows marked in `delete` dropped."""
    kept = target.join(changes.select(*key), key, "left_anti")
    live = changes if delete is None else changes.filter(~F.col(delete))
    return kept.unionByName(live.select(*target.columns))


def advance_cursor(state: DataFrame, batch: DataFrame, channel: list[str], time: str, incremental: bool = True) -> DataFrame:
    """Checkpoint rows after a batch: watermarks widen, counters add up, an incremental run starts again at cursor 1."""
    seen = batch.groupBy(*channel).agg(F.max(time).alias("h"), F.min(time).alias("l"), F.count("*").alias("s"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("Created", "Changed", "Failed")])
    j = state.join(seen, channel, "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        *channel,
        F.greatest("high_watermark", "h").alias("high_watermark"),
        F.least("low_watermark", "l").alias("low_watermark"),
        (n("scanned") + n("s")).alias("scanned"),
        (n("created") + n("n_Created")).alias("created"),
        (n("changed") + n("n_Changed")).alias("changed"),
        (n("failed") + n("n_Failed")).alias("failed"),
        (F.lit(1) if incremental else n("next_cursor") + F.when(F.col("s").isNotNull(), 1).otherwise(0)).cast("long").alias("next_cursor"),
    )


def run_is_done(batch: DataFrame) -> bool:
    """An incremental run ends at a page without created, changed or failed rows."""
    return batch.filter(F.col("outcome").isin("Created", "Changed", "Failed")).isEmpty()


def quiet_channels(batch: DataFrame, channel: list[str]) -> DataFrame:
    """Channels whose page had no created, changed or failed row: their incremental run ends."""
    return batch.groupBy(*channel).agg(F.count_if(F.col("outcome").isin("Created", "Changed", "Failed")).alias("__n")).filter("__n = 0").select(*channel)


def enqueue(queue: DataFrame, jobs: DataFrame, key: str = "deduplication_key") -> DataFrame:
    """Jobs to append: those whose key is not waiting or running, one per key; jobs without a key all stay."""
    active = queue.filter(F.col("status").isin("Pending", "Running") & F.col(key).isNotNull()).select(key)
    keyed = first_per_key(jobs.filter(F.col(key).isNotNull()), [key], [F.col("id")]).join(active, key, "left_anti")
    return jobs.filter(F.col(key).isNull()).unionByName(keyed.select(*jobs.columns))


def next_job_state(as_of: Column, initial: float = 30, most: float = 3600) -> Column:
    """struct(status, next_attempt_at) of a job row by its status, result, attempts and lease.

    Reads status, outcome (Succeeded, Failed or null), attempt_count, max_attempts, lease_until, cancel_requested.
    """
    c = F.col
    lost = (c("status") == "Running") & c("outcome").isNull() & (c("lease_until") < as_of)
    failed = (c("status") == "Running") & ((c("outcome") == "Failed") | lost)
    spent = c("attempt_count") >= c("max_attempts")
    status = ladder(
        [
            (~c("status").isin("Pending", "Running"), c("status")),
            (c("cancel_requested") & ((c("status") == "Pending") | failed), "Cancelled"),
            ((c("status") == "Running") & (c("outcome") == "Succeeded"), "Succeeded"),
            (failed & spent, "DeadLetter"),
            (failed, "Pending"),
        ],
        c("status"),
    )
    again = F.when(failed & ~spent & ~c("cancel_requested"), F.timestamp_seconds(F.unix_seconds(as_of.cast("timestamp")) + backoff_seconds(c("attempt_count"), initial, most).cast("long")))
    return F.struct(status.alias("status"), again.alias("next_attempt_at"))


def unseen(batch: DataFrame, inbox: DataFrame, keys: list[str]) -> DataFrame:
    """Messages that a consumer has not handled yet, one per key."""
    return batch.dropDuplicates(keys).join(inbox.select(*keys), keys, "left_anti")


def retained(rows: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """Rows younger than the retention."""
    return rows.filter(F.col(time) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def refreshed_links(old: DataFrame, drafts: DataFrame, key: str, confirmed: str) -> DataFrame:
    """Links after a refresh: confirmed ones stay as they are, unconfirmed ones give way to the drafts."""
    fixed = old.filter(confirmed)
    return fixed.unionByName(drafts.join(fixed.select(key), key, "left_anti").select(*old.columns))


def reconciled(exports: DataFrame, jobs: DataFrame, key: str = "deduplication_key") -> DataFrame:
    """exports with `action` (Fail, Requeue, Link or Unchanged) and the `job_id` found: by their own job id, else by their key.

    A dead or cancelled job fails the export, no job at all queues it again, a job that the export doesn't name is linked.
    Exports that are Ready or Failed stay as they are. Of several jobs with one key the newest counts.
    """
    by_id = jobs.select(F.col("id").alias("background_job_id"), F.col("status").alias("__own"))
    by_key = jobs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("id", "status")).alias("__other"))
    met = exports.join(by_id, "background_job_id", "left").join(by_key, key, "left")
    found = F.when(F.col("__own").isNotNull(), F.struct(F.col("background_job_id").alias("id"), F.col("__own").alias("status"))).otherwise(F.col("__other"))
    met = met.withColumn("__job", found)
    action = ladder(
        [
            (F.col("status").isin("Ready", "Failed"), "Unchanged"),
            (F.col("__job.status").isin("DeadLetter", "Cancelled"), "Fail"),
            (F.col("__job.id").isNull(), "Requeue"),
            (~F.col("__job.id").eqNullSafe(F.col("background_job_id")), "Link"),
        ],
        "Unchanged",
    )
    return met.withColumn("action", action).select(*exports.columns, "action", F.col("__job.id").alias("job_id"))


def due_channels(channels: DataFrame, as_of: Column, most: int) -> DataFrame:
    """Enabled channels whose interval has passed, never scanned ones first, then the longest waiting."""
    due = F.col("last_scan_time").isNull() | (F.unix_seconds(F.col("last_scan_time").cast("timestamp")) + F.col("scan_interval_minutes") * 60 <= F.unix_seconds(as_of.cast("timestamp")))
    return channels.filter(F.col("enabled") & due).orderBy(F.col("last_scan_time").asc_nulls_first(), "id").limit(most)
