"""Ingestion-state jobs over the raw feed bound to ``events``.

Binding: source = event_type, source_doc_id = user_id, payload = props,
fetched_at = ts.  Rows before FEED_SPLIT_TS form the previous state (last
arrival per key), rows from it on are the incoming batch.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import ingest as I
from tidewater.operators.archive import RawArchive, backfill_newer
from tidewater.registry import job
from tidewater.scratch import Scratch
from tidewater.sources import tables as T
from tidewater.sources.oracle_bindings import RAW_FEED_CTE, with_ctes

KEYS = ["source_id", "source_doc_id"]
FIELDS = ["program_id", "source_portal", "payload", "max_amount", "period_end"]
ORDER = ["fetched_at", "seq"]
RUN_TS = dt.datetime(2024, 2, 1)
FEED_AS_OF = dt.date(2024, 1, 25)
CLOSE_AS_OF = dt.date(2024, 2, 10)
DIGEST_SINCE = dt.datetime(2024, 1, 2, 12)


#: A previous state row whose last event had this value or more counts as closed by hand.
CLOSED_VALUE = 100.0


def raw_feed(spark, sf):
    return T.raw_feed_from_events(T.load(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"]))


def normalized_feed(spark, sf):
    """(rows to merge, rejects): an 'error' event has no title and is not normalizable; an amount that
    cannot be computed (k = 0) is a failing row."""
    return judged_feed(raw_feed(spark, sf))


def judged_feed(raw):
    """``normalized_feed`` of any raw rows, batch or stream."""
    k = F.get_json_object("payload", "$.k").try_cast("int")
    rows = raw.withColumns({
        "title": F.when(F.col("source_id") != "error", F.upper("source_id")), "k": k,
        "max_amount": F.try_divide(F.lit(1000000), k).cast("long")})
    problem = F.when(F.col("max_amount").isNull(), F.concat(F.lit("no amount in "), F.coalesce("payload", F.lit("empty payload"))))
    good, bad = I.split_valid(rows, ["source_doc_id", "title"], problem)
    good = good.select(
        *KEYS, "payload", "fetched_at", "seq", "value",
        F.concat(F.substring(F.upper("source_id"), 1, 2), F.lit("-"), F.col("source_doc_id")).alias("program_id"),
        F.col("title").alias("source_portal"), "max_amount",
        F.date_add(F.to_date("fetched_at"), F.col("k")).alias("period_end"), I.content_hash("payload").alias("content_hash"))
    return good, bad


def previous_state(feed):
    pre = feed.where(F.col("fetched_at") < F.lit(T.FEED_SPLIT_TS))
    last = I.last_arrival(pre.select(*KEYS, *FIELDS, "content_hash", "value", *ORDER), KEYS, ORDER)
    firsts = pre.groupBy(*KEYS).agg(F.min("fetched_at").alias("created_at"),
                                    F.max("fetched_at").alias("last_seen_at"))
    return last.join(firsts, KEYS).select(
        *KEYS, *FIELDS, "content_hash", "created_at", "last_seen_at", F.col("last_seen_at").alias("synced_at"),
        (I.is_open(F.col("period_end"), FEED_AS_OF) & (F.col("value") < CLOSED_VALUE)).alias("is_open"))


def batch(feed):
    return feed.where(F.col("fetched_at") >= F.lit(T.FEED_SPLIT_TS))


def merged(spark, sf):
    feed, _ = normalized_feed(spark, sf)
    return I.upsert(previous_state(feed), batch(feed), KEYS, FIELDS, RUN_TS, FEED_AS_OF, ORDER), feed


# The oracle replays the batch row by row: ``step`` compares each row's hash with the one before it.
FEED_SQL = with_ctes(RAW_FEED_CTE) + """,
judged AS (
  SELECT *, CAST(json_extract_string(payload, '$.k') AS INTEGER) AS k,
         CASE WHEN CAST(json_extract_string(payload, '$.k') AS INTEGER) = 0 THEN 'error'
              WHEN source_id = 'error' THEN 'invalid' END AS reject FROM raw_feed),
feed AS (
  SELECT source_id, source_doc_id, payload, fetched_at, seq, value,
         substr(upper(source_id), 1, 2) || '-' || source_doc_id AS program_id, upper(source_id) AS source_portal,
         CAST(1000000 // k AS BIGINT) AS max_amount, CAST(fetched_at AS DATE) + k AS period_end,
         sha256(CAST(json_object('payload', payload, 'rules_version', 4) AS VARCHAR)) AS content_hash
  FROM judged WHERE reject IS NULL),
pre AS (SELECT * FROM feed WHERE fetched_at < TIMESTAMP '2024-01-20 00:00:00'),
post AS (SELECT * FROM feed WHERE fetched_at >= TIMESTAMP '2024-01-20 00:00:00'),
prev AS (
  SELECT l.source_id, l.source_doc_id, l.program_id, l.source_portal, l.payload, l.max_amount, l.period_end,
         l.content_hash, f.created_at, f.last_seen_at, f.last_seen_at AS synced_at,
         l.period_end >= DATE '2024-01-25' AND l.value < 100 AS is_open
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, source_doc_id
                                                    ORDER BY fetched_at DESC, seq DESC) AS rn FROM pre) WHERE rn = 1) l
  JOIN (SELECT source_id, source_doc_id, min(fetched_at) AS created_at, max(fetched_at) AS last_seen_at
        FROM pre GROUP BY 1, 2) f USING (source_id, source_doc_id)),
step AS (
  SELECT p.*, v.content_hash AS state_hash,
         coalesce(lag(p.content_hash) OVER (PARTITION BY p.source_id, p.source_doc_id ORDER BY p.fetched_at, p.seq), v.content_hash)
           IS DISTINCT FROM p.content_hash AS written,
         row_number() OVER (PARTITION BY p.source_id, p.source_doc_id ORDER BY p.fetched_at DESC, p.seq DESC) AS back
  FROM post p LEFT JOIN prev v USING (source_id, source_doc_id)),
net AS (SELECT source_id, source_doc_id, bool_or(written) AS changed, count(*) AS n, count(*) FILTER (WHERE written) AS n_written
        FROM step GROUP BY 1, 2),
final AS (SELECT s.*, n.changed FROM step s JOIN net n USING (source_id, source_doc_id) WHERE s.back = 1),
state2 AS (
  SELECT source_id, source_doc_id,
         CASE WHEN b.changed THEN b.program_id ELSE s.program_id END AS program_id,
         CASE WHEN b.changed THEN b.source_portal ELSE s.source_portal END AS source_portal,
         CASE WHEN b.changed THEN b.payload ELSE s.payload END AS payload,
         CASE WHEN b.changed THEN b.max_amount ELSE s.max_amount END AS max_amount,
         CASE WHEN b.changed THEN b.period_end ELSE s.period_end END AS period_end,
         CASE WHEN b.changed THEN b.content_hash ELSE s.content_hash END AS content_hash,
         coalesce(s.created_at, TIMESTAMP '2024-02-01 00:00:00') AS created_at,
         CASE WHEN b.seq IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE s.last_seen_at END AS last_seen_at,
         CASE WHEN b.changed THEN TIMESTAMP '2024-02-01 00:00:00' ELSE s.synced_at END AS synced_at,
         CASE WHEN s.content_hash IS NULL THEN 'inserted' WHEN b.changed THEN 'updated'
              WHEN b.seq IS NOT NULL THEN 'unchanged' ELSE 'untouched' END AS outcome,
         CASE WHEN b.changed THEN b.period_end >= DATE '2024-01-25' ELSE s.is_open END AS is_open
  FROM prev s FULL OUTER JOIN final b USING (source_id, source_doc_id))
"""

STATE_COLS = KEYS + FIELDS + ["content_hash", "created_at", "last_seen_at", "synced_at", "outcome", "is_open"]


@job("i2_upsert", sql=FEED_SQL + f"SELECT {', '.join(STATE_COLS)} FROM state2")
def i2_upsert(spark, sf):
    m, _ = merged(spark, sf)
    return m.select(*STATE_COLS)


@job("i6_run_summary", sql=FEED_SQL + """,
bad AS (SELECT * FROM judged WHERE reject IS NOT NULL AND fetched_at >= TIMESTAMP '2024-01-20 00:00:00'),
c AS (SELECT (SELECT coalesce(sum(n), 0) FROM net) AS merged, (SELECT coalesce(sum(n_written), 0) FROM net) AS upserted,
             count(*) FILTER (WHERE reject = 'invalid') AS invalid, count(*) FILTER (WHERE reject = 'error') AS errors,
             'no amount in ' || arg_min(payload, CASE WHEN reject = 'error' THEN seq END) FILTER (WHERE reject = 'error') AS first_error FROM bad)
SELECT 'batch' AS run_id, CAST(merged + invalid + errors AS BIGINT) AS fetched, CAST(upserted AS BIGINT) AS upserted,
       CAST(merged - upserted + invalid AS BIGINT) AS skipped, CAST(errors AS BIGINT) AS errors, first_error,
       CASE WHEN errors = 0 THEN 'success' WHEN upserted > 0 THEN 'partial' ELSE 'failed' END AS status
FROM c""")
def i6_run_summary(spark, sf):
    feed, rejects = normalized_feed(spark, sf)
    counts = I.replay_counts(previous_state(feed), batch(feed), KEYS, ORDER)
    return I.run_summary(counts, batch(rejects), "batch")


#: A run of the ledger: one source's rows of an hour.
RUN_SQL = "strftime(date_trunc('hour', fetched_at), '%Y-%m-%d %H') || ' ' || source_id"


@job("i6_run_ledger", sql=FEED_SQL + f""",
ran AS (SELECT {RUN_SQL} AS run_id, source_id, source_doc_id, fetched_at, seq, content_hash,
               lag(content_hash) OVER (PARTITION BY source_id, source_doc_id ORDER BY fetched_at, seq) IS DISTINCT FROM content_hash AS written FROM feed),
m AS (SELECT run_id, count(*) AS merged, count(*) FILTER (WHERE written) AS upserted FROM ran GROUP BY 1),
b AS (SELECT {RUN_SQL} AS run_id, count(*) FILTER (WHERE reject = 'invalid') AS invalid, count(*) FILTER (WHERE reject = 'error') AS errors,
             'no amount in ' || arg_min(payload, seq) FILTER (WHERE reject = 'error') AS first_error FROM judged WHERE reject IS NOT NULL GROUP BY 1),
j AS (SELECT run_id, coalesce(merged, 0) AS merged, coalesce(upserted, 0) AS upserted, coalesce(invalid, 0) AS invalid, coalesce(errors, 0) AS errors, first_error
      FROM m FULL OUTER JOIN b USING (run_id))
SELECT run_id, merged + invalid + errors AS fetched, upserted, merged - upserted + invalid AS skipped, errors, first_error,
       CASE WHEN errors = 0 THEN 'success' WHEN upserted > 0 THEN 'partial' ELSE 'failed' END AS status FROM j""")
def i6_run_ledger(spark, sf):
    """One ledger row per run (a source's rows of an hour) of the whole feed, from an empty state."""
    feed, rejects = normalized_feed(spark, sf)
    run = F.concat(F.date_format(F.date_trunc("hour", "fetched_at"), "yyyy-MM-dd HH"), F.lit(" "), F.col("source_id"))
    return I.run_ledger(feed.withColumn("run_id", run), rejects.withColumn("run_id", run), KEYS, ORDER)


@job("i7_rejects", sql=FEED_SQL + """
SELECT source_id, source_doc_id, seq, reject, CASE WHEN reject = 'error' THEN 'no amount in ' || payload END AS error
FROM judged WHERE reject IS NOT NULL""")
def i7_rejects(spark, sf):
    """Rows that failed or cannot be normalized; none of them stops the others."""
    _, rejects = normalized_feed(spark, sf)
    return rejects.select(*KEYS, "seq", "reject", "error")


@job("i12_backfill_created", sql=FEED_SQL + """
SELECT source_id, source_doc_id, coalesce(CASE WHEN is_open THEN created_at END, CASE WHEN value_known THEN synced_at END,
       TIMESTAMP '2024-02-01 00:00:00') AS created_at
FROM (SELECT *, max_amount > 20000 AS value_known FROM prev)""")
def i12_backfill_created(spark, sf):
    """Creation times that a state without them gets: its sync time, else the run's time."""
    feed, _ = normalized_feed(spark, sf)
    state = previous_state(feed).withColumns({
        "created_at": F.when(F.col("is_open"), F.col("created_at")),
        "synced_at": F.when(F.col("max_amount") > 20000, F.col("synced_at"))})
    return I.backfill_created(state, RUN_TS).select(*KEYS, "created_at")


@job("s7_archive_raw", sql=FEED_SQL + """
SELECT DISTINCT source_id, source_doc_id, content_hash, payload FROM post
WHERE source_doc_id IS NOT NULL
  AND (source_id, source_doc_id, content_hash) NOT IN (SELECT source_id, source_doc_id, content_hash FROM pre)""")
def s7_archive_raw(spark, sf):
    feed, _ = normalized_feed(spark, sf)
    pre = feed.where(F.col("fetched_at") < F.lit(T.FEED_SPLIT_TS))
    new = I.archive_raw(pre, batch(feed))
    return new.select("source_id", "source_doc_id", "content_hash", "payload")


@job("i8_next_since", sql=with_ctes(RAW_FEED_CTE) + """
SELECT CAST(max(CAST(fetched_at AS DATE)) AS TIMESTAMP) AS max_published,
       CAST(coalesce(max(CAST(fetched_at AS DATE)) - INTERVAL 7 DAY, DATE '2024-02-01' - INTERVAL 30 DAY) AS DATE) AS since
FROM raw_feed WHERE source_id <> 'error'""")
def i8_next_since(spark, sf):
    published = F.when(F.col("source_id") == "error", F.lit("date unknown")).otherwise(F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))
    feed = raw_feed(spark, sf).select(published.alias("published_at"))
    out = I.next_since(feed, RUN_TS.date())
    return out.select("max_published", F.col("since").cast("date").alias("since"))


#: Runs of the archive jobs: each takes the events of eight days of the month.
RUN_DAYS, RUNS = 8, 4
ARCHIVED_SQL = with_ctes(RAW_FEED_CTE, f"""
arch AS (SELECT source_id, source_doc_id, payload, fetched_at, seq, CAST(day(fetched_at) - 1 AS INTEGER) // {RUN_DAYS} AS run
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id, source_doc_id, payload ORDER BY fetched_at, seq) AS r FROM raw_feed) WHERE r = 1)""")


def run_batches(spark, sf):
    """The raw feed with its run; an 'error' event has no date of publication."""
    published = F.when(F.col("source_id") == "error", F.lit("date unknown")).otherwise(F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))
    return raw_feed(spark, sf).withColumns({
        "published_at": published, "content_hash": I.content_hash("payload"), "run": F.floor((F.dayofmonth("fetched_at") - 1) / RUN_DAYS).cast("int")})


@job("i8_source_marks", sql=ARCHIVED_SQL + """
SELECT source_id, count(*) AS n_rows, max(CASE WHEN source_id <> 'error' THEN CAST(fetched_at AS DATE) END) AS max_published,
  CAST(coalesce(max(CASE WHEN source_id <> 'error' THEN CAST(fetched_at AS DATE) END) - INTERVAL 7 DAY, DATE '2024-02-01' - INTERVAL 30 DAY) AS DATE) AS since
FROM arch GROUP BY 1""")
def i8_source_marks(spark, sf):
    """I8 per source after several runs: rows archived, mark and start of the next run, read from the manifest."""
    feed = run_batches(spark, sf)
    rows = feed.drop("run")
    archive = RawArchive(spark, Scratch(spark, "archive").folder("raw"), rows.schema)
    for run in range(RUNS):
        archive.append(run, feed.where(F.col("run") == run).drop("run"))
    return archive.since(RUN_TS.date())


@job("i11_backfill_by_runs", sql=ARCHIVED_SQL + """,
per AS (SELECT source_id, source_doc_id, run, arg_max(payload, (fetched_at, seq)) AS v, max(fetched_at) AS taken
  FROM arch WHERE payload IS NOT NULL AND trim(payload) <> '' GROUP BY ALL),
steps AS (SELECT *, lag(v) OVER (PARTITION BY source_id, source_doc_id ORDER BY run) AS was FROM per)
SELECT k.source_id, k.source_doc_id, arg_max(v, run) AS payload, max(taken) AS payload_ts, CAST(count(*) FILTER (WHERE v IS DISTINCT FROM was) AS INTEGER) AS fills
FROM (SELECT DISTINCT source_id, source_doc_id FROM raw_feed) k LEFT JOIN steps USING (source_id, source_doc_id) GROUP BY 1, 2""")
def i11_backfill_by_runs(spark, sf):
    """I11 in step with the archive: after each run the state takes newer values from the rows above its reader's marks alone."""
    feed = run_batches(spark, sf)
    scratch = Scratch(spark, "archive")
    archive = RawArchive(spark, scratch.folder("raw"), feed.drop("run").schema)
    state = feed.select(*KEYS).distinct().withColumns({
        "payload": F.lit(None).cast("string"), "payload_ts": F.lit(None).cast("timestamp"), "payload_seq": F.lit(None).cast("long"), "fills": F.lit(0)})
    for run in range(RUNS):
        archive.append(run, feed.where(F.col("run") == run).drop("run"))
        rows, marks = archive.pending("state")
        state = backfill_newer(state, rows, KEYS, "payload", "fetched_at", "seq").withColumn("fills", F.col("fills") + F.col("backfilled").cast("int"))
        state = scratch.write(state.drop("backfilled"), "state")
        archive.acknowledge("state", marks)
    return state.drop("payload_seq")


@job("i10_new_digest", sql=FEED_SQL + """
SELECT program_id, source_portal, period_end, created_at FROM state2
WHERE created_at >= TIMESTAMP '2024-01-02 12:00:00'
ORDER BY period_end ASC NULLS LAST, program_id ASC LIMIT 30""")
def i10_new_digest(spark, sf):
    m, _ = merged(spark, sf)
    return I.new_digest(m, DIGEST_SINCE, I.DIGEST_ROWS).select("program_id", "source_portal", "period_end", "created_at")


@job("i11_backfill_latest", sql=FEED_SQL + """,
latest AS (SELECT source_id, source_doc_id, payload AS latest FROM (
             SELECT *, row_number() OVER (PARTITION BY source_id, source_doc_id ORDER BY fetched_at DESC, seq DESC) AS rn
             FROM feed WHERE payload IS NOT NULL AND trim(payload) <> '') WHERE rn = 1)
SELECT p.source_id, p.source_doc_id,
       CASE WHEN l.latest IS NOT NULL AND p.payload IS DISTINCT FROM l.latest THEN l.latest ELSE p.payload END AS payload,
       l.latest IS NOT NULL AND p.payload IS DISTINCT FROM l.latest AS backfilled
FROM prev p LEFT JOIN latest l USING (source_id, source_doc_id)""")
def i11_backfill_latest(spark, sf):
    feed, _ = normalized_feed(spark, sf)
    latest = I.latest_nonempty(feed, KEYS, "payload", "fetched_at", "seq")
    out = I.backfill_latest(previous_state(feed), latest, KEYS, "payload")
    return out.select(*KEYS, "payload", "backfilled")


@job("i13_portal_summary", sql=FEED_SQL + """
SELECT source_portal, count(*) AS total, count(*) FILTER (WHERE is_open) AS open FROM state2 GROUP BY 1""")
def i13_portal_summary(spark, sf):
    m, _ = merged(spark, sf)
    return I.portal_summary(m)


@job("i5_close_expired", sql=FEED_SQL + """
SELECT source_id, source_doc_id,
       is_open AND period_end IS NOT NULL AND period_end < DATE '2024-02-10' AS closed_now,
       CASE WHEN is_open AND period_end IS NOT NULL AND period_end < DATE '2024-02-10' THEN false ELSE is_open END AS is_open
FROM state2""")
def i5_close_expired(spark, sf):
    m, _ = merged(spark, sf)
    out = I.close_expired(m.withColumn("auto_ingested", F.lit(True)), CLOSE_AS_OF)
    return out.select(*KEYS, "closed_now", "is_open")


@job("i9_delta_report", sql=FEED_SQL + """
SELECT b.n AS before_total, a.n AS after_total, a.n - b.n AS new, greatest(0, u.n - (a.n - b.n)) AS updated
FROM (SELECT count(*) AS n FROM prev) b, (SELECT count(*) AS n FROM state2) a,
     (SELECT count(*) AS n FROM state2 WHERE outcome IN ('inserted', 'updated')) u""")
def i9_delta_report(spark, sf):
    m, feed = merged(spark, sf)
    return I.delta_report(previous_state(feed), m, m.where(F.col("outcome").isin("inserted", "updated")))
