"""Streaming jobs (T1-T4): each runs its stream over all available files and returns what it has written."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewater.jobs import ingest_jobs as J
from tidewater.jobs.matching_jobs import PAIRS_SQL as MATCH_CTES
from tidewater.operators import ingest as I
from tidewater.registry import job
from tidewater.scratch import Scratch
from tidewater.sources import tables as T
from tidewater.streaming import streams as S

BURST_LIMIT = 1  # requests per client per 10-minute window before a burst is reported
STREAM_LIMIT = 2
FEED_START = dt.date(2024, 1, 1)


def table_stream(spark, sf, name):
    """The files of a table (a folder, or one file of the tables' folder) as a stream."""
    path = f"{sf.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if S.is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def finish(query):
    query.awaitTermination()
    return query


def landed(spark, rows, scratch, part: str, parts: int, run):
    """Land ``rows`` in ``parts`` portions and call ``run(stream)`` after each, as a polled job would."""
    folder = scratch.folder("landed")
    schema = rows.drop(part).schema
    for i in range(parts):
        rows.where(F.col(part) == i).drop(part).write.parquet(f"{folder}/run={i}")
        run(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder))
    return folder


@job("t3_burst_windows", sql=f"""
SELECT user_id AS client, time_bucket(INTERVAL '10 minutes', ts) AS window_start,
       time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS window_end, count(*) AS requests
FROM events GROUP BY 1, 2 HAVING count(*) > {BURST_LIMIT}""")
def t3_burst_windows(spark, sf):
    """Clients with more than BURST_LIMIT requests in a 10-minute tumbling window."""
    return S.burst_windows(T.load(spark, sf, "events", ["user_id", "ts"]), limit=BURST_LIMIT)


@job("t3_burst_stream", sql=f"""
SELECT event_type AS client, time_bucket(INTERVAL '10 minutes', ts) AS window_start,
       time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS window_end, count(*) AS requests
FROM events GROUP BY 1, 2 HAVING count(*) > {STREAM_LIMIT}
  AND time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def t3_burst_stream(spark, sf):
    """The same on a stream that lands in portions of ten days: windows come out once, when the watermark closes them."""
    scratch = Scratch(spark, "t3")
    rows = T.load(spark, sf, "events", ["event_type", "ts"])
    rows = rows.withColumn("part", F.least(F.floor(F.datediff("ts", F.lit(FEED_START)) / 10), F.lit(2)).cast("int"))
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    out, checkpoint = scratch.folder("rows"), scratch.folder("checkpoint")

    def run(stream):
        bursts = S.burst_windows_stream(stream, client="event_type", limit=STREAM_LIMIT)
        finish(bursts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())

    landed(spark, rows, scratch, "part", 3, run)
    return spark.read.parquet(out)


@job("t1_stream_upsert", sql=J.FEED_SQL + """,
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, source_doc_id ORDER BY fetched_at DESC, seq DESC) AS r FROM feed) WHERE r = 1)
SELECT source_id, source_doc_id, program_id, payload, max_amount, period_end, content_hash, TIMESTAMP '2024-02-01 00:00:00' AS created_at,
       period_end >= DATE '2024-01-25' AS is_open FROM last""")
def t1_stream_upsert(spark, sf):
    """The whole feed as a stream into an empty state."""
    scratch = Scratch(spark, "t1")
    raw = T.raw_feed_from_events(table_stream(spark, sf, "events"))
    good, _ = J.judged_feed(raw)
    root = scratch.folder("state")
    finish(S.continuous_upsert(good, root, J.KEYS, J.FIELDS, J.ORDER, J.RUN_TS, J.FEED_AS_OF, scratch.folder("checkpoint")))
    out = S.upsert_state(good, root, J.KEYS, J.FIELDS).read()
    return out.select(*J.KEYS, "program_id", "payload", "max_amount", "period_end", "content_hash", "created_at", "is_open")


@job("t1_stream_batches", sql=J.FEED_SQL + """,
step2 AS (SELECT *, lag(content_hash) OVER k IS DISTINCT FROM content_hash AS written FROM feed
          WINDOW k AS (PARTITION BY source_id, source_doc_id ORDER BY fetched_at, seq)),
runs AS (SELECT *, CAST(least(date_diff('day', DATE '2024-01-01', CAST(fetched_at AS DATE)) // 10, 2) AS INTEGER) AS run FROM step2),
last AS (SELECT source_id, source_doc_id, arg_max(struct_pack(payload := payload, h := content_hash), (fetched_at, seq)) AS l,
                max(run) AS seen, max(run) FILTER (WHERE written) AS synced FROM runs GROUP BY 1, 2)
SELECT source_id, source_doc_id, l.payload AS payload, l.h AS content_hash, CASE WHEN seen < 2 THEN NULL ELSE seen = synced END AS written_last FROM last""")
def t1_stream_batches(spark, sf):
    """The feed in three runs into one bucketed state; whether the last run wrote a row (null: it did not meet it)."""
    scratch = Scratch(spark, "t1b")
    good, _ = J.normalized_feed(spark, sf)
    rows = good.withColumn("part", F.least(F.floor(F.datediff("fetched_at", F.lit(FEED_START)) / 10), F.lit(2)).cast("int"))
    root, checkpoint = scratch.folder("state"), scratch.folder("checkpoint")
    folder = landed(spark, rows, scratch, "part", 3, lambda stream: finish(S.continuous_upsert(stream, root, J.KEYS, J.FIELDS, J.ORDER, J.RUN_TS, J.FEED_AS_OF, checkpoint, buckets=16)))
    out = S.upsert_state(good, root, J.KEYS, J.FIELDS, 16).read()
    last = spark.read.parquet(f"{folder}/run=2").select(*J.KEYS).distinct().withColumn("met", F.lit(True))
    out = out.join(last, J.KEYS, "left")
    return out.select(*J.KEYS, "payload", "content_hash", F.when(F.col("met"), F.col("outcome").isin("inserted", "updated")).alias("written_last"))


@job("t2_stream_dedup", sql=J.FEED_SQL + "SELECT DISTINCT source_id, source_doc_id, content_hash FROM feed")
def t2_stream_dedup(spark, sf):
    """Raw documents of the stream without repetitions inside the bound (60 days cover the feed)."""
    scratch = Scratch(spark, "t2")
    good, _ = J.judged_feed(T.raw_feed_from_events(table_stream(spark, sf, "events")))
    out = scratch.folder("rows")
    good = good.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    kept = S.dedup_raw(good, bound="60 days").select("source_id", "source_doc_id", "content_hash")
    finish(kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.folder("checkpoint"))
           .outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(out)


@job("t2_late_rows", sql=J.FEED_SQL + """,
arrived AS (SELECT *, CAST(least((date_diff('day', DATE '2024-01-01', CAST(fetched_at AS DATE)) + CASE WHEN seq % 13 = 0 THEN 10 WHEN seq % 7 = 0 THEN 3 ELSE 0 END) // 9, 3) AS INTEGER) AS batch FROM feed),
highs AS (SELECT batch, max(max(fetched_at)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 7 DAY AS bound FROM arrived GROUP BY batch),
judged2 AS (SELECT a.*, bound, coalesce(fetched_at < bound, false) AS late FROM arrived a JOIN highs USING (batch)),
firsts AS (SELECT source_id, source_doc_id, content_hash, batch, any_value(bound) AS bound, min(struct_pack(f := fetched_at, s := seq)) AS one, max(fetched_at) AS top
           FROM judged2 WHERE NOT late GROUP BY 1, 2, 3, 4),
known AS (SELECT *, max(top) OVER (PARTITION BY source_id, source_doc_id, content_hash ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM firsts)
SELECT 'kept' AS output, batch, source_id, source_doc_id, content_hash, one.s AS seq FROM known WHERE before IS NULL OR before < bound
UNION ALL SELECT 'late', batch, source_id, source_doc_id, content_hash, seq FROM judged2 WHERE late""")
def t2_late_rows(spark, sf):
    """Documents that arrive late (some by 3, some by 10 days) in four runs: new ones, and those after the bound of 7 days."""
    scratch = Scratch(spark, "t2l")
    good, _ = J.normalized_feed(spark, sf)
    delay = F.when(F.col("seq") % 13 == 0, 10).when(F.col("seq") % 7 == 0, 3).otherwise(0)
    rows = good.select(*J.KEYS, "content_hash", F.col("fetched_at").cast("timestamp").alias("fetched_at"), "seq",
                       F.least(F.floor((F.datediff("fetched_at", F.lit(FEED_START)) + delay) / 9), F.lit(3)).cast("int").alias("part"))
    root, checkpoint = scratch.folder("dedup"), scratch.folder("checkpoint")
    keys = [*J.KEYS, "content_hash"]
    landed(spark, rows, scratch, "part", 4, lambda stream: finish(S.dedup_with_late(stream, root, checkpoint, keys, "fetched_at", ["fetched_at", "seq"], buckets=16)))
    read = lambda kind: spark.read.parquet(f"{root}/{kind}").select(F.lit(kind).alias("output"), F.col("batch").cast("int").alias("batch"), *keys, "seq")
    return read("kept").unionByName(read("late"))


@job("t4_match_on_arrival", sql=MATCH_CTES + """
SELECT program_id, CAST(count(*) AS BIGINT) AS profiles, max(match_score) AS best FROM scored GROUP BY 1""")
def t4_match_on_arrival(spark, sf):
    """Arriving notices with the number of profiles that they match, and the best score."""
    scratch = Scratch(spark, "t4")
    profiles = T.profiles_from_customer(T.load(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))
    feed = S.ArrivalFeed(spark, scratch.folder("matches"))
    finish(feed.follow(table_stream(spark, sf, "part"), profiles, scratch.folder("checkpoint"), T.match_notices_from_part))
    return feed.totals()


@job("t4_changing_profiles", sql=MATCH_CTES + """
SELECT program_id, CAST(count(*) AS BIGINT) AS profiles, max(match_score) AS best FROM scored WHERE profile_id % 3 <> 0 GROUP BY 1""")
def t4_changing_profiles(spark, sf):
    """Notices land in two portions, the profiles change between them and once more after the last notice."""
    scratch = Scratch(spark, "t4c")
    profiles = T.profiles_from_customer(T.load(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))
    notices = T.match_notices_from_part(T.load(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]))
    feed, root, checkpoint = S.MatchFeed(spark, scratch.folder("matches")), scratch.folder("profiles"), scratch.folder("checkpoint")
    versions = iter(["profile_id % 2 = 0", "profile_id % 5 < 3"])

    def run(stream):
        number, rule = len(feed._steps()), next(versions)
        profiles.where(rule).write.parquet(f"{root}/v={number:06d}")
        finish(feed.follow(stream, root, checkpoint))

    landed(spark, notices.withColumn("part", (F.col("program_id") % 2).cast("int")), scratch, "part", 2, run)
    profiles.where("profile_id % 3 <> 0").write.parquet(f"{root}/v=999999")
    feed.refresh(root)
    return feed.totals()
