"""Ingestion state: hashing, change-detecting merge, archive, ledger, watermark.

The merge is set-oriented and gives what a row-by-row replay of the batch would give: the
batch is reduced per natural key to its last arrival and to the smallest and largest content hash
(partial aggregation, so a key holding a third of the batch is combined map-side), then
full-outer-joined with the state.  A key changed if its hashes and the state's hash are not
all equal, so a batch that changes a row and changes it back is an update, too.  Results go to a
new versioned snapshot; the path being read is never overwritten.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.common import attach_scalar

NORMALIZER_VERSION = 4


def content_hash(*cols: str, version: int = NORMALIZER_VERSION) -> Column:
    """Sha-256 of the raw row as JSON (NULL differs from '') and of the rules version."""
    row = F.to_json(F.struct(*cols, F.lit(version).alias("rules_version")), {"ignoreNullFields": "false"})
    return F.sha2(row.cast("binary"), 256)


def last_arrival(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Reduce a batch to the last arrival per key (ties broken by the order columns)."""
    value_cols = [c for c in batch.columns if c not in keys]
    agg = batch.groupBy(*keys).agg(F.max_by(F.struct(*value_cols), F.struct(*order)).alias("_last"))
    return agg.select(*keys, "_last.*")


def is_open(period_end: Column, as_of) -> Column:
    """I4: open unless the end date has passed; no end date = open."""
    return F.coalesce(period_end >= F.lit(as_of), F.lit(True))


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], fields: list[str], run_ts, as_of,
           order: list[str]) -> DataFrame:
    """I2 + I3 + I4: merge ``batch`` into ``state``.

    state columns: keys + fields + content_hash, created_at, last_seen_at, synced_at, is_open
    batch columns: keys + fields + content_hash + order columns
    Output: the new state plus ``outcome`` in (inserted, updated, unchanged, untouched).
    Openness is set when a row is inserted or changed; any other row keeps its flag, also one
    that was closed by hand.  Keys with a NULL part are no natural key and are left out of the merge.
    """
    b = batch.select(*keys, *fields, "content_hash", *order)
    for k in keys:
        b = b.where(F.col(k).isNotNull())
    b = b.groupBy(*keys).agg(
        F.max_by(F.struct(*fields, "content_hash"), F.struct(*order)).alias("_last"),
        F.min("content_hash").alias("_lo"), F.max("content_hash").alias("_hi"))
    s = state.select(*keys, *fields, "content_hash", "created_at", "last_seen_at", "synced_at", "is_open",
                     F.lit(True).alias("_in_state"))
    j = s.join(b, keys, "full_outer")
    in_batch = F.col("_last").isNotNull()
    in_state = F.coalesce(F.col("_in_state"), F.lit(False))
    same = F.col("content_hash").eqNullSafe(F.col("_lo")) & F.col("content_hash").eqNullSafe(F.col("_hi"))
    changed = in_batch & (~in_state | ~same)
    outcome = (F.when(in_batch & ~in_state, F.lit("inserted")).when(changed, F.lit("updated"))
                .when(in_batch, F.lit("unchanged")).otherwise(F.lit("untouched")))
    ts = F.lit(run_ts).cast("timestamp")
    new = lambda f: F.col("_last")[f]
    open_now = is_open(new("period_end"), as_of) if "period_end" in fields else F.lit(True)
    return j.select(
        *[F.col(k) for k in keys],
        *[F.when(changed, new(f)).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(changed, new("content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(in_batch & ~in_state, ts).otherwise(F.col("created_at")).alias("created_at"),
        F.when(in_batch, ts).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(changed, ts).otherwise(F.col("synced_at")).alias("synced_at"),
        outcome.alias("outcome"),
        F.when(changed, open_now).otherwise(F.col("is_open")).alias("is_open"))


def split_valid(rows: DataFrame, required: list[str], error: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to merge, rows that failed).

    ``error`` is a text for a row that cannot be processed, else NULL (built from try_* functions,
    so no row can stop the batch).  A row that lacks a required value is ``invalid``: not
    normalizable, but no error.
    """
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    judged = rows.withColumns({"error": error, "reject": F.when(error.isNotNull(), "error").when(missing, "invalid")})
    return judged.where(F.col("reject").isNull()).drop("error", "reject"), judged.where(F.col("reject").isNotNull())


def replay_counts(state: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key: rows of the batch, and how many of them a row-by-row replay would write (upserted).

    A row is written if its hash differs from the one before it (the state's for the first).
    Rows are compared within (key, day of arrival) first; days of a key meet in a second, small
    step, so a key that holds a third of the batch is not one task's work.
    """
    b = batch.withColumn("_day", F.to_date(order[0]))
    day = Window.partitionBy(*keys, "_day").orderBy(*order)
    b = b.withColumn("_before", F.lag("content_hash").over(day))
    days = b.groupBy(*keys, "_day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_before").isNotNull() & (F.col("_before") != F.col("content_hash"))).alias("inside"),
        F.min_by("content_hash", F.struct(*order)).alias("first"), F.max_by("content_hash", F.struct(*order)).alias("last"))
    days = days.join(state.select(*keys, F.col("content_hash").alias("_state")), keys, "left")
    prior = F.coalesce(F.lag("last").over(Window.partitionBy(*keys).orderBy("_day")), F.col("_state"))
    days = days.withColumn("_prior", prior)
    return days.groupBy(*keys).agg(
        F.sum("n").alias("fetched"),
        F.sum(F.col("inside") + (~F.col("_prior").eqNullSafe(F.col("first"))).cast("int")).alias("upserted"))


def archive_raw(archive: DataFrame, batch: DataFrame, key_cols=("source_id", "source_doc_id", "content_hash")):
    """New raw rows; duplicates on (source, doc, hash) in the batch or the archive are ignored.

    Rows are kept even when normalization fails, provided they carry a document id.
    """
    keys = list(key_cols)
    b = batch.where(F.col("source_doc_id").isNotNull())
    rest = [c for c in b.columns if c not in keys]
    if "fetched_at" in rest:  # of equal documents the first one fetched is archived
        b = b.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("fetched_at", *[c for c in ("seq",) if c in rest])).alias("_first")).select(*keys, "_first.*")
    else:
        b = b.dropDuplicates(keys)
    return b.join(archive.select(*keys), keys, "left_anti")


def close_expired(state: DataFrame, as_of) -> DataFrame:
    """Auto-ingested, open notices whose end date has passed are closed; flag kept for counting."""
    expired = (F.coalesce(F.col("auto_ingested"), F.lit(False)) & F.col("is_open")
               & F.col("period_end").isNotNull() & (F.col("period_end") < F.lit(as_of)))
    return state.withColumn("closed_now", expired).withColumn(
        "is_open", F.when(expired, F.lit(False)).otherwise(F.col("is_open")))


def run_summary(counts: DataFrame, rejects: DataFrame, run_id: str, seq: str = "seq") -> DataFrame:
    """Fetched, upserted, skipped (unchanged or not normalizable), errors, first error and status of a run.

    ``counts`` from ``replay_counts``, ``rejects`` from ``split_valid``.
    """
    good = counts.agg(F.coalesce(F.sum("fetched"), F.lit(0)).alias("merged"), F.coalesce(F.sum("upserted"), F.lit(0)).alias("upserted"))
    bad = rejects.agg(
        F.count_if(F.col("reject") == "invalid").alias("invalid"), F.count_if(F.col("reject") == "error").alias("errors"),
        F.min_by(F.col("error"), F.when(F.col("reject") == "error", F.col(seq))).alias("first_error"))
    j = attach_scalar(good, bad)
    status = (F.when(F.col("errors") == 0, F.lit("success"))
               .when(F.col("upserted") > 0, F.lit("partial")).otherwise(F.lit("failed")))
    return j.select(F.lit(run_id).alias("run_id"), (F.col("merged") + F.col("invalid") + F.col("errors")).cast("long").alias("fetched"),
                    F.col("upserted").cast("long").alias("upserted"),
                    (F.col("merged") - F.col("upserted") + F.col("invalid")).cast("long").alias("skipped"),
                    F.col("errors").cast("long").alias("errors"), "first_error", status.alias("status"))


def valid_date(published: str) -> Column:
    """The date that a text starts with, as a timestamp; NULL where it starts with none."""
    return F.when(F.col(published).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(F.col(published), 1, 10), F.lit("yyyy-MM-dd")))


def next_since(raw: DataFrame, as_of, lookback_days=7, default_days=30,
               published="published_at") -> DataFrame:
    """I8: start of the next incremental run: max valid publication date - 7 days, else today - 30."""
    m = raw.agg(F.max(valid_date(published)).alias("max_published"))
    return m.select("max_published", F.coalesce(
        F.date_sub(F.to_date("max_published"), lookback_days),
        F.date_sub(F.lit(as_of), default_days)).alias("since"))


#: Rows of the catalogue's own digest (a top-k report).
DIGEST_ROWS = 30


def new_digest(state: DataFrame, run_start, n: int | None = None) -> DataFrame:
    """Notices created since the run start, soonest deadline first, NULL deadlines last; the first n, or all."""
    out = (state.where(F.col("created_at") >= F.lit(run_start).cast("timestamp"))
                .orderBy(F.col("period_end").asc_nulls_last(), F.col("program_id").asc()))
    return out if n is None else out.limit(n)


def latest_nonempty(raw: DataFrame, keys: list[str], value: str, ts: str, seq: str) -> DataFrame:
    """I11 source side: the latest non-empty value per key (DISTINCT ON ... ORDER BY ts DESC)."""
    r = raw.where(F.col(value).isNotNull() & (F.trim(F.col(value)) != ""))
    return r.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(ts, seq)).alias("latest"))


def backfill_latest(state: DataFrame, latest: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Fill ``col`` from the latest raw value only where it differs (null-safe)."""
    j = state.join(latest, keys, "left")
    differs = F.col("latest").isNotNull() & ~F.col(col).eqNullSafe(F.col("latest"))
    return j.withColumn("backfilled", differs).withColumn(
        col, F.when(differs, F.col("latest")).otherwise(F.col(col))).drop("latest")


def backfill_created(state: DataFrame, now) -> DataFrame:
    """created_at = coalesce(created_at, synced_at, now)."""
    return state.withColumn("created_at", F.coalesce("created_at", "synced_at", F.lit(now).cast("timestamp")))


def delta_report(before: DataFrame, after: DataFrame, upserted: DataFrame) -> DataFrame:
    """new = total after - total before; updated = max(0, upserted - new)."""
    b = before.agg(F.count(F.lit(1)).alias("before_total"))
    a = after.agg(F.count(F.lit(1)).alias("after_total"))
    u = upserted.agg(F.count(F.lit(1)).alias("upserted"))
    j = attach_scalar(attach_scalar(b, a), u)
    new = F.col("after_total") - F.col("before_total")
    return j.select("before_total", "after_total", new.alias("new"),
                    F.greatest(F.lit(0), F.col("upserted") - new).alias("updated"))


def portal_summary(state: DataFrame, portal="source_portal") -> DataFrame:
    """Ingested notices per portal: total and open."""
    return state.groupBy(portal).agg(F.count(F.lit(1)).alias("total"),
                                     F.count_if(F.col("is_open")).alias("open"))


def run_ledger(good: DataFrame, rejects: DataFrame, keys: list[str], order: list[str], run: str = "run_id", seq: str = "seq") -> DataFrame:
    """I6 over many runs in one job: one row per run, as if the runs had been replayed one after the other.

    ``good`` and ``rejects`` (from ``split_valid``) carry ``run``; runs follow each other in its order.  A row counts as
    upserted if its hash differs from the one before it; the first row of a key in a run is compared with the last row of
    that key in any earlier run, so the state of all runs is carried along.  Rows are compared inside (key, run)
    first; only one row per key and run takes part in the second step.
    """
    inside = Window.partitionBy(*keys, run).orderBy(*order)
    g = good.withColumn("_before", F.lag("content_hash").over(inside))
    per = g.groupBy(*keys, run).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_before").isNotNull() & (F.col("_before") != F.col("content_hash"))).alias("inside"),
        F.min_by("content_hash", F.struct(*order)).alias("first"), F.max_by("content_hash", F.struct(*order)).alias("last"))
    prior = F.lag("last").over(Window.partitionBy(*keys).orderBy(run))
    per = per.withColumn("written", F.col("inside") + (~prior.eqNullSafe(F.col("first"))).cast("int"))
    merged = per.groupBy(run).agg(F.sum("n").alias("merged"), F.sum("written").alias("upserted"))
    bad = rejects.groupBy(run).agg(
        F.count_if(F.col("reject") == "invalid").alias("invalid"), F.count_if(F.col("reject") == "error").alias("errors"),
        F.min_by(F.col("error"), F.when(F.col("reject") == "error", F.col(seq))).alias("first_error"))
    j = merged.join(bad, run, "full_outer").fillna(0, ["merged", "upserted", "invalid", "errors"])
    status = F.when(F.col("errors") == 0, "success").when(F.col("upserted") > 0, "partial").otherwise("failed")
    return j.select(run, (F.col("merged") + F.col("invalid") + F.col("errors")).cast("long").alias("fetched"), F.col("upserted").cast("long").alias("upserted"),
                    (F.col("merged") - F.col("upserted") + F.col("invalid")).cast("long").alias("skipped"), F.col("errors").cast("long").alias("errors"),
                    "first_error", status.alias("status"))
