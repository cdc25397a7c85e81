"""Structured Streaming re-aims of the polled ingestion.

* T1 ``continuous_upsert``: file-source stream of raw rows -> ``foreachBatch`` merge (I2 semantics) into a
  bucketed state; a micro-batch rewrites the buckets of its keys only, idempotent per batch id.
* T2 ``dedup_raw`` drops duplicate raw documents within a bound; ``dedup_with_late`` also returns the rows that came
  after the bound had passed.
* T3 ``burst_windows``: requests per client per 10-minute tumbling window above a limit, on batches, or on a
  stream in append mode, where the watermark closes the windows.
* T4 ``match_on_arrival``: new notices scored against the profiles as they arrive, in ``ArrivalFeed`` once per signature;
  ``MatchFeed`` keeps the matches current while profiles change.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import ingest as I
from tidewater.operators import matching as M
from tidewater.streaming.bucket_state import BUCKETS, BucketState, Files


def burst_windows(events: DataFrame, client="user_id", ts="ts", limit: int = 20,
                  window="10 minutes") -> DataFrame:
    """Clients above ``limit`` requests in a tumbling window (batch or stream)."""
    w = events.groupBy(F.window(ts, window).alias("w"), F.col(client).alias("client")) \
              .agg(F.count(F.lit(1)).alias("requests"))
    return w.where(F.col("requests") > limit).select(
        "client", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")


def burst_windows_stream(events_stream: DataFrame, client="user_id", ts="ts", limit: int = 20,
                         window="10 minutes", late="10 minutes") -> DataFrame:
    """T3 on a stream: the watermark bounds the window state; append mode emits closed windows."""
    return burst_windows(events_stream.withWatermark(ts, late), client, ts, limit, window)


def dedup_raw(raw_stream: DataFrame, keys=("source_id", "source_doc_id", "content_hash"),
              ts="fetched_at", bound="7 days") -> DataFrame:
    """Drop repeated raw documents seen within the late-data bound."""
    return raw_stream.withWatermark(ts, bound).dropDuplicatesWithinWatermark(list(keys))


def is_folder(spark: SparkSession, path: str) -> bool:
    files = Files(spark, path)
    return files.fs.getFileStatus(files.path(path)).isDirectory()


def latest_snapshot(spark: SparkSession, root: str) -> str | None:
    """Path of the newest committed snapshot ``root/v=<number>`` in any Hadoop file system."""
    files = Files(spark, root)
    done = [n for n in files.names(root) if n.startswith("v=") and files.exists(f"{root}/{n}/_SUCCESS")]
    return f"{root}/{done[-1]}" if done else None


def _in_batches(stream: DataFrame, step, checkpoint: str):
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---------------------------------------------------------------- T1

def upsert_state(rows: DataFrame, state_root: str, keys: list[str], fields: list[str], buckets: int = BUCKETS) -> BucketState:
    """The state that ``continuous_upsert`` keeps of such rows."""
    return BucketState(rows.sparkSession, state_root, keys, _empty_state(rows, keys, fields).schema, buckets)


def continuous_upsert(raw_stream: DataFrame, state_root: str, keys: list[str], fields: list[str],
                      order: list[str], run_ts, as_of, checkpoint: str, buckets: int = BUCKETS):
    """Merge each micro-batch into the buckets that its keys belong to.

    A batch id with a manifest is skipped, so a replayed batch is idempotent, and the run's time is a
    parameter, so a replay gives the same rows.  Keys with a null part are no natural key and are left out.
    """
    def merge(batch_df: DataFrame, batch_id: int):
        state = upsert_state(batch_df, state_root, keys, fields, buckets)
        if state.done(batch_id):
            return
        rows = batch_df.dropna(subset=keys).persist()
        touched = state.touched(rows)
        merged = I.upsert(state.read(touched), rows, keys, fields, run_ts, as_of, order)
        state.commit(batch_id, merged, touched)
        rows.unpersist()

    return _in_batches(raw_stream, merge, checkpoint)


# ---------------------------------------------------------------- T2

def dedup_with_late(raw_stream: DataFrame, root: str, checkpoint: str, keys: list[str], ts: str, order: list[str], days: int = 7, buckets: int = BUCKETS):
    """Each micro-batch adds the rows that are new to ``root/kept`` and those that came too late to ``root/late``.

    The bound of a batch is the largest event time of the batches before it, less ``days``; there is none in the first.
    A row under the bound, or without an event time, is late: its duplicates may be forgotten already.  Of the others the
    first of each key (by ``order``) is kept, unless the key had a row in time in an earlier batch whose
    event time is not under the bound.  The state holds the last event time of each key and forgets keys under the
    bound.  Outputs are folders per batch, overwritten by a replay, and the state follows them.
    """
    def step(batch_df: DataFrame, batch_id: int):
        spark = batch_df.sparkSession
        state = seen_state(batch_df, f"{root}/seen", keys, ts, buckets)
        if state.done(batch_id):
            return
        rows = batch_df.persist()
        high = state.latest()["notes"].get("high")
        bound = None if high is None else F.timestamp_micros(F.lit(high)) - F.expr(f"interval {days} days")
        late = F.col(ts).isNull() if bound is None else F.coalesce(F.col(ts) < bound, F.lit(True))
        rows.where(late).write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        fine = rows.where(~late).dropna(subset=keys)
        rest = [c for c in rows.columns if c not in keys]
        mine = fine.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"), F.max(ts).alias("_now"))
        touched = state.touched(fine)
        known = state.read(touched)
        old = known.select(*keys, F.col("last").alias("_last"))
        new = mine.join(old, keys, "left")
        new = new.where(F.col("_last").isNull() if bound is None else F.col("_last").isNull() | (F.col("_last") < bound))
        new.select(*keys, "_first.*").select(*rows.columns).write.mode("overwrite").parquet(f"{root}/kept/batch={batch_id}")
        top = rows.agg(F.unix_micros(F.max(ts))).first()[0]
        high = top if high is None else max(high, top or high)
        after = known.unionByName(mine.select(*keys, F.col("_now").alias("last"))).groupBy(*keys).agg(F.max("last").alias("last"))
        if high is not None:
            after = after.where(F.col("last") >= F.timestamp_micros(F.lit(high)) - F.expr(f"interval {days} days"))
        state.commit(batch_id, after, touched, {"high": high})
        rows.unpersist()

    return _in_batches(raw_stream, step, checkpoint)


def seen_state(rows: DataFrame, root: str, keys: list[str], ts: str, buckets: int = BUCKETS) -> BucketState:
    return BucketState(rows.sparkSession, root, keys, rows.select(*keys, F.col(ts).alias("last")).schema, buckets)


# ---------------------------------------------------------------- T4

def match_on_arrival(notices_stream: DataFrame, profiles: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """T4: (profile class, program_id, score, evidence) of each arriving notice.

    Stream-static equi-join on segment and stage tokens.  The static side holds distinct profile signatures
    (``classes``), not profiles, so a notice meets each signature once whatever the number of profiles
    behind it; ``profile_members`` leads from a signature to its profiles.
    """
    pc = profile_members(profiles, as_of_year).groupBy("pkey").agg(
        F.first("p_segs").alias("p_segs"), F.first("p_stages").alias("p_stages"), F.first("p_ind").alias("p_ind"), F.count(F.lit(1)).alias("profiles"))
    return class_matches(M.notice_classes(notices_stream), pc).select("pkey", "program_id", "profiles", "match_score", "evidence")


class ArrivalFeed:
    """T4 as written tables: ``match_on_arrival`` of each micro-batch, with notices reduced to signatures, too.

    ``root/notices/batch=<id>`` (program_id, nkey) names the signature of each notice, ``root/matches/batch=<id>`` (nkey, pkey,
    profiles, match_score, evidence) the matches of the batch's distinct signatures: they are scored once, whatever the
    number of notices behind them.  Folders are overwritten by a replay.
    """

    def __init__(self, spark: SparkSession, root: str, as_of_year: int = 2026):
        self.spark, self.root, self.as_of_year = spark, root, as_of_year

    def follow(self, rows_stream: DataFrame, profiles: DataFrame, checkpoint: str, notices_of=lambda rows: rows):
        """Run the stream; ``notices_of`` makes notices of its rows, inside the micro-batch: arrays with null elements that
        the stream's own plan makes do not reach the batch as they are."""
        def step(batch_df: DataFrame, batch_id: int):
            rows = notice_members(notices_of(batch_df))
            one = signatures(rows).select(F.col("nkey").alias("program_id"), F.col("t_segs").alias("target_segments"),
                                          F.col("t_stages").alias("target_stages"), F.col("t_inds").alias("target_industries"))
            found = match_on_arrival(one, profiles, self.as_of_year).withColumnRenamed("program_id", "nkey")
            found.write.mode("overwrite").parquet(f"{self.root}/matches/batch={batch_id}")
            rows.select("program_id", "nkey").write.mode("overwrite").parquet(f"{self.root}/notices/batch={batch_id}")

        return _in_batches(rows_stream, step, checkpoint)

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}")

    def matches(self) -> DataFrame:
        """(pkey, program_id, profiles, match_score, evidence) of the notices so far: as many rows as there are matches."""
        found = self._read("notices").join(self._read("matches"), ["batch", "nkey"])
        return found.select("pkey", "program_id", "profiles", "match_score", "evidence")

    def totals(self) -> DataFrame:
        """(program_id, profiles, best) of the notices with a match, summed up per signature first."""
        return notice_totals(self._read("notices"), self._read("matches"), ["batch", "nkey"])


def notice_totals(notices: DataFrame, matches: DataFrame, on: list[str]) -> DataFrame:
    """Number of matching profiles and best score per notice, from the matches of its signature."""
    per = matches.groupBy(*on).agg(F.sum("profiles").alias("profiles"), F.max("match_score").alias("best"))
    return notices.join(per, on).groupBy("program_id").agg(F.sum("profiles").cast("long").alias("profiles"), F.max("best").alias("best"))


def notice_members(notices: DataFrame) -> DataFrame:
    """Notices with the key of their signature."""
    return M.notice_classes(notices).withColumn("nkey", F.sha2(F.to_json(F.struct("t_segs", "t_stages", "t_inds")), 256))


def signatures(members: DataFrame) -> DataFrame:
    return members.groupBy("nkey").agg(F.first("t_segs").alias("t_segs"), F.first("t_stages").alias("t_stages"), F.first("t_inds").alias("t_inds"))


def class_matches(notices: DataFrame, classes: DataFrame) -> DataFrame:
    """Scored pairs of notices and signatures that share a token."""
    tokens = lambda segs, stages: F.concat(F.transform(segs, lambda s: F.concat(F.lit("seg:"), s)), F.transform(stages, lambda s: F.concat(F.lit("stage:"), s)))
    p = classes.select("*", tokens("p_segs", "p_stages").alias("p_tok")).withColumn("tok", F.explode("p_tok"))
    n = notices.select("*", tokens("t_segs", "t_stages").alias("t_tok")).withColumn("tok", F.explode("t_tok"))
    # a pair that shares several tokens is kept at the first of them: no state, no distinct over the stream
    j = n.join(p, "tok").where(F.col("tok") == F.element_at(F.array_intersect("t_tok", "p_tok"), 1))
    return M.score_pairs(j)


def profile_members(profiles: DataFrame, as_of_year: int = 2026) -> DataFrame:
    p = M.profile_classes(profiles, as_of_year)
    return p.withColumn("pkey", F.sha2(F.to_json(F.struct("p_segs", "p_stages", "p_ind")), 256))


class MatchFeed:
    """T4 with changing profiles: matches of profile signatures and notice signatures, kept current step by step.

    A step is a batch of notices or a new snapshot of the profiles.  Notice signatures that are new meet the profile signatures
    of the newest snapshot.  A snapshot re-matches only signatures whose number of profiles goes from zero (against all notice
    signatures so far) or to zero (their matches end); profiles that join or leave a signature, and notices of a known
    signature, cost no match.  Matches are appended per step, an ended signature is a row that outdates its earlier
    matches, and a step counts once its manifest is there.
    """

    def __init__(self, spark: SparkSession, root: str, as_of_year: int = 2026):
        self.spark, self.root, self.as_of_year = spark, root, as_of_year
        self.files = Files(spark, root)

    def _steps(self) -> list[dict]:
        return [json.loads(self.files.read(f"{self.root}/manifest/{n}")) for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json")]

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{s['folder']}/{kind}" for s in self._steps() if kind in s["kinds"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, name: str, tables: dict[str, DataFrame]) -> None:
        no = len(self._steps())
        folder = f"data/{no:08d}-{uuid.uuid4().hex}"
        for kind, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{kind}")
        self.files.publish(f"{self.root}/manifest/{no:08d}.json", json.dumps({"name": name, "folder": folder, "kinds": sorted(tables)}))

    def _classes(self) -> DataFrame:
        """The current signatures: those of the last snapshot step."""
        last = [s for s in self._steps() if "classes" in s["kinds"]]
        return self.spark.read.schema(CLASS).parquet(f"{self.root}/{last[-1]['folder']}/classes") if last else self.spark.createDataFrame([], CLASS)

    def on_profiles(self, profiles: DataFrame, version: str) -> None:
        """Take the snapshot ``version``; a version that was taken is skipped."""
        if any(s["name"] == f"profiles {version}" for s in self._steps()):
            return
        old = self._classes()
        new = profile_members(profiles, self.as_of_year).groupBy("pkey").agg(
            F.first("p_segs").alias("p_segs"), F.first("p_stages").alias("p_stages"), F.first("p_ind").alias("p_ind"), F.count(F.lit(1)).alias("profiles"))
        step = F.lit(len(self._steps()))
        born = new.join(old, "pkey", "left_anti")
        gone = old.join(new, "pkey", "left_anti").select("pkey", step.alias("step"))
        found = class_matches(self._read("signatures", SIGNATURE), born).select("pkey", "nkey", "match_score", step.alias("step"))
        self._commit(f"profiles {version}", {"classes": new.select(*[c.split()[0] for c in CLASS.split(", ")]), "matches": found, "ended": gone})

    def on_notices(self, notices: DataFrame, name: str) -> None:
        """Match a batch of notices; a batch that was taken is skipped."""
        if any(s["name"] == f"notices {name}" for s in self._steps()):
            return
        rows = notice_members(notices)
        new = signatures(rows).join(self._read("signatures", SIGNATURE), "nkey", "left_anti")
        found = class_matches(new, self._classes()).select("pkey", "nkey", "match_score", F.lit(len(self._steps())).alias("step"))
        self._commit(f"notices {name}", {"notices": rows.select("program_id", "nkey"), "signatures": new, "matches": found})

    def follow(self, notices_stream: DataFrame, profile_root: str, checkpoint: str):
        """Run the stream; each micro-batch first takes the newest profile snapshot under ``profile_root``."""
        def step(batch_df: DataFrame, batch_id: int):
            self.refresh(profile_root)
            self.on_notices(batch_df, str(batch_id))

        return _in_batches(notices_stream, step, checkpoint)

    def refresh(self, profile_root: str) -> None:
        """Take the newest profile snapshot, also when no notice has come."""
        path = latest_snapshot(self.spark, profile_root)
        if path is not None:
            self.on_profiles(self.spark.read.parquet(path), path.rsplit("/", 1)[1])

    def signature_matches(self) -> DataFrame:
        """(nkey, pkey, match_score, profiles) of the current signatures."""
        ended = self._read("ended", "pkey string, step int").groupBy("pkey").agg(F.max("step").alias("end"))
        rows = self._read("matches", "pkey string, nkey string, match_score int, step int").join(ended, "pkey", "left")
        rows = rows.where(F.col("end").isNull() | (F.col("step") >= F.col("end")))
        return rows.join(self._classes().select("pkey", "profiles"), "pkey").select("nkey", "pkey", "match_score", "profiles")

    def matches(self) -> DataFrame:
        """(program_id, pkey, match_score, profiles) of the current signatures: as many rows as there are matches."""
        return self._read("notices", NOTICE).join(self.signature_matches(), "nkey").select("program_id", "pkey", "match_score", "profiles")

    def totals(self) -> DataFrame:
        """(program_id, profiles, best) of the notices with a match, summed up per signature first."""
        return notice_totals(self._read("notices", NOTICE), self.signature_matches(), ["nkey"])


CLASS = "pkey string, p_segs array<string>, p_stages array<string>, p_ind string, profiles long"
NOTICE = "program_id long, nkey string"
SIGNATURE = "nkey string, t_segs array<string>, t_stages array<string>, t_inds array<string>"


def _empty_state(batch_df: DataFrame, keys, fields) -> DataFrame:
    cols = [F.col(k) for k in keys] + [F.col(f) for f in fields] + [
        F.col("content_hash"), F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_seen_at"), F.lit(None).cast("timestamp").alias("synced_at"),
        F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("boolean").alias("is_open")]
    return batch_df.select(*cols).limit(0)
