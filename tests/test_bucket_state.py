"""Bucketed stream state, late rows, changing profiles."""
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewater.operators import ingest as I
from tidewater.sources import tables as T
from tidewater.streaming import streams as S
from tidewater.streaming.bucket_state import BucketState, Files

SF = "/root/testdata/sf0.001"
FEED = "k string, period_end date, content_hash string, seq int"
NOW, DAY = dt.datetime(2024, 2, 1), dt.date(2024, 1, 15)


def state_of(spark, tmp_path, keep=2):
    schema = spark.createDataFrame([], "k string, v int").schema
    return BucketState(spark, "file://" + str(tmp_path / "state"), ["k"], schema, buckets=8, keep=keep)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v int")


def values(state):
    return {r.k: r.v for r in state.read().collect()}


def test_one_key_touches_one_bucket(spark, tmp_path):
    state = state_of(spark, tmp_path)
    first = rows(spark, [(f"k{i}", i) for i in range(100)])
    state.commit(0, first, state.touched(first))
    before = state.latest()["buckets"]
    assert len(before) == 8 and len(values(state)) == 100
    one = rows(spark, [("k7", -1)])
    touched = state.touched(one)
    assert len(touched) == 1
    merged = state.read(touched).join(one.select("k"), "k", "left_anti").unionByName(one)
    state.commit(1, merged, touched)
    after = state.latest()["buckets"]
    assert [b for b in after if after[b] != before[b]] == [str(touched[0])]
    assert values(state) == {**{f"k{i}": i for i in range(100)}, "k7": -1}


def test_a_crash_between_write_and_swap_changes_nothing(spark, tmp_path, monkeypatch):
    state = state_of(spark, tmp_path)
    first = rows(spark, [("a", 1), ("b", 2)])
    state.commit(0, first, state.touched(first))

    def crash(*_):
        raise RuntimeError("lost driver")

    second = rows(spark, [("a", 9)])
    with monkeypatch.context() as m:
        m.setattr(BucketState, "_swap", crash)
        with pytest.raises(RuntimeError):
            state.commit(1, second, state.touched(second))
    assert values(state) == {"a": 1, "b": 2} and not state.done(1)
    state.commit(1, second, state.touched(second))
    assert values(state) == {"a": 9, "b": 2} and state.done(1)
    assert not [n for n in os.listdir(tmp_path / "state" / "manifest") if n.endswith(".tmp")]
    # the crashed batch's folder is named by no manifest
    named = {f.split("/")[1] for n in os.listdir(tmp_path / "state" / "manifest") if n.endswith(".json")
             for f in json.load(open(tmp_path / "state" / "manifest" / n))["buckets"].values()}
    assert set(os.listdir(tmp_path / "state" / "data")) == named


def test_old_versions_expire(spark, tmp_path):
    state = state_of(spark, tmp_path, keep=2)
    for batch in range(6):
        one = rows(spark, [("same", batch)])
        state.commit(batch, one, state.touched(one))
    assert values(state) == {"same": 5} and len(os.listdir(tmp_path / "state" / "data")) == 2


def test_a_bucket_can_become_empty(spark, tmp_path):
    state = state_of(spark, tmp_path)
    one = rows(spark, [("x", 1)])
    state.commit(0, one, state.touched(one))
    state.commit(1, one.where("false"), state.touched(one), {"high": 7})
    assert values(state) == {} and state.latest() == {"buckets": {}, "notes": {"high": 7}}


def test_publishing_a_name_twice_fails_or_replaces_whole(spark, tmp_path):
    files = Files(spark, "file://" + str(tmp_path))
    files.publish("file://" + str(tmp_path / "a.json"), "one")
    assert files.read("file://" + str(tmp_path / "a.json")) == "one"


def land(spark, folder, df, n):
    df.coalesce(1).write.parquet(f"{folder}/run={n}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(folder)


def test_merge_in_runs_touches_the_buckets_of_its_keys(spark, tmp_path):
    folder, root = "file://" + str(tmp_path / "in"), "file://" + str(tmp_path / "state")
    day = dt.date(2024, 6, 1)
    parts = [[(f"k{i}", day, "A", i) for i in range(50)] + [(None, day, "A", 99)], [("k3", day, "B", 100)], [("k3", day, "B", 101), ("new", None, "C", 102)]]
    seen = []
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part, FEED)
        S.continuous_upsert(land(spark, folder, df, n), root, ["k"], ["period_end"], ["seq"], NOW, DAY, str(tmp_path / "ck"), buckets=16).awaitTermination()
        seen.append(S.upsert_state(df, root, ["k"], ["period_end"], 16).latest()["buckets"])
    assert sum(seen[0].get(b) != f for b, f in seen[1].items()) == 1
    got = {r.k: (r.content_hash, r.outcome) for r in S.upsert_state(df, root, ["k"], ["period_end"], 16).read().collect()}
    assert len(got) == 51 and got["k3"] == ("B", "unchanged") and got["new"] == ("C", "inserted") and got["k4"][0] == "A"
    # the state equals one merge of everything
    every = spark.createDataFrame([r for p in parts for r in p], FEED)
    one = I.upsert(S._empty_state(every, ["k"], ["period_end"]).drop("outcome"), every, ["k"], ["period_end"], NOW, DAY, ["seq"])
    assert {r.k: r.content_hash for r in one.collect()} == {k: h for k, (h, _) in got.items()}


def test_late_rows_equal_a_replay(spark, tmp_path):
    import random
    rnd = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    batches = []
    for b in range(4):
        part = [(f"d{rnd.randrange(25)}", start + dt.timedelta(hours=24 * 6 * b + rnd.randrange(-24 * 14, 24 * 6)), b * 1000 + i) for i in range(80)]
        batches.append(part + [(f"null{b}", None, b * 1000 + 900), (None, start + dt.timedelta(days=6 * b), b * 1000 + 901)])
    folder, root = "file://" + str(tmp_path / "in"), "file://" + str(tmp_path / "dedup")
    for n, part in enumerate(batches):
        df = spark.createDataFrame(part, "doc string, at timestamp, seq int")
        for _ in range(2):  # a second run has nothing new and changes nothing
            stream = land(spark, folder, df, n) if _ == 0 else stream
            S.dedup_with_late(stream, root, str(tmp_path / "ck"), ["doc"], "at", ["at", "seq"], buckets=4).awaitTermination()
    got_kept = sorted(r.seq for r in spark.read.parquet(f"{root}/kept").collect())
    got_late = sorted(r.seq for r in spark.read.parquet(f"{root}/late").collect())
    kept, late, high, last = [], [], None, {}
    for part in batches:
        bound = None if high is None else high - dt.timedelta(days=7)
        fine = [r for r in part if r[1] is not None and (bound is None or r[1] >= bound)]
        late += [r[2] for r in part if r not in fine]
        mine = {}
        for r in sorted((r for r in fine if r[0] is not None), key=lambda r: (r[1], r[2])):
            mine.setdefault(r[0], []).append(r)
        for doc, rs in mine.items():
            if doc not in last or (bound is not None and last[doc] < bound):
                kept.append(rs[0][2])
        for doc, rs in mine.items():
            last[doc] = max(last.get(doc, rs[-1][1]), rs[-1][1])
        high = max([r[1] for r in part if r[1] is not None] + ([high] if high else []))
    assert got_kept == sorted(kept) and got_late == sorted(late) and len(late) > 20
    state = S.seen_state(df, f"{root}/seen", ["doc"], "at", 4)
    assert all(r.last >= high - dt.timedelta(days=7) for r in state.read().collect())


def test_only_born_and_ended_signatures_are_matched_anew(spark, tmp_path):
    profiles = T.profiles_from_customer(T.load(spark, SF, "customer"))
    notices = T.match_notices_from_part(T.load(spark, SF, "part"))
    feed = S.MatchFeed(spark, "file://" + str(tmp_path / "m"))
    feed.on_notices(notices.where("program_id % 2 = 0"), "a")
    assert feed.matches().count() == 0  # nobody to match yet
    feed.on_profiles(profiles.where("profile_id <= 60"), "1")
    feed.on_notices(notices.where("program_id % 2 = 1"), "b")
    feed.on_profiles(profiles.where("profile_id <= 60").unionByName(profiles.where("profile_id <= 60").withColumn("profile_id", F.col("profile_id") + 10_000)), "2")
    last = feed._steps()[-1]
    assert spark.read.parquet(f"{feed.root}/{last['folder']}/matches").count() == 0  # counts changed, no signature did
    feed.on_profiles(profiles.where("profile_id between 30 and 90"), "3")
    steps = len(feed._steps())
    feed.on_profiles(profiles.where("false"), "3")
    feed.on_notices(notices, "b")
    assert len(feed._steps()) == steps  # steps that were taken are skipped
    got = sorted((r.program_id, r.pkey, r.match_score, r.profiles) for r in feed.matches().collect())
    one = S.match_on_arrival(notices, profiles.where("profile_id between 30 and 90")).collect()
    assert got == sorted((r.program_id, r.pkey, r.match_score, r.profiles) for r in one) and got
    feed.on_profiles(profiles.where("profile_id = 1"), "4")
    feed.on_profiles(profiles.where("profile_id between 30 and 90"), "5")  # a signature that ended and came back
    assert sorted((r.program_id, r.pkey, r.match_score, r.profiles) for r in feed.matches().collect()) == got


def copies(notices, n):
    return notices.crossJoin(notices.sparkSession.range(n)).withColumn("program_id", F.col("program_id") + F.col("id") * 100_000).drop("id")


def pair_totals(pairs):
    out = {}
    for r in pairs.collect():
        n, best = out.get(r.program_id, (0, 0))
        out[r.program_id] = n + r.profiles, max(best, r.match_score)
    return out


def test_matches_are_written_per_signature_of_notices(spark, tmp_path):
    profiles = T.profiles_from_customer(T.load(spark, SF, "customer"))
    notices = T.match_notices_from_part(T.load(spark, SF, "part")).where("program_id <= 40")
    want = pair_totals(S.match_on_arrival(copies(notices, 9), profiles))
    feed = S.MatchFeed(spark, "file://" + str(tmp_path / "m"))
    feed.on_profiles(profiles, "1")
    feed.on_notices(notices, "a")
    found = lambda: spark.read.parquet(*[f"{feed.root}/{s['folder']}/matches" for s in feed._steps()]).count()
    once = found()
    feed.on_notices(copies(notices, 9).where("program_id >= 100000"), "b")
    assert found() == once and want  # eight copies of each notice: no further match
    assert {r.program_id: (r.profiles, r.best) for r in feed.totals().collect()} == want == pair_totals(feed.matches())


def test_arrivals_are_matched_per_signature_of_notices(spark, tmp_path):
    profiles = T.profiles_from_customer(T.load(spark, SF, "customer"))
    notices = copies(T.match_notices_from_part(T.load(spark, SF, "part")).where("program_id <= 40"), 9).unionByName(
        spark.createDataFrame([(None, "n", "a", "f", ["SMB"], ["예비"], None)] * 2, "program_id long, name string, agency string, field string, target_segments array<string>, target_stages array<string>, target_industries array<string>"))
    notices.write.parquet(str(tmp_path / "in"))
    feed = S.ArrivalFeed(spark, "file://" + str(tmp_path / "m"))
    feed.follow(spark.readStream.schema(notices.schema).parquet(str(tmp_path / "in")), profiles, str(tmp_path / "c")).awaitTermination()
    pairs = S.match_on_arrival(notices, profiles)
    assert spark.read.parquet(f"{feed.root}/matches").count() * 8 < pairs.count()
    key = lambda r: (r.program_id or 0, r.pkey, r.profiles, r.match_score, tuple(r.evidence))
    assert sorted(map(key, feed.matches().collect())) == sorted(map(key, pairs.collect()))
    got = {r.program_id: (r.profiles, r.best) for r in feed.totals().collect()}
    assert got == pair_totals(pairs) and None in got


def test_arrivals_keep_null_elements(spark, tmp_path):
    T.load(spark, SF, "part").withColumn("p_size", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size"))).write.parquet(str(tmp_path / "part"))
    part = spark.read.parquet(str(tmp_path / "part"))
    profiles = T.profiles_from_customer(T.load(spark, SF, "customer"))
    feed = S.ArrivalFeed(spark, "file://" + str(tmp_path / "m"))
    feed.follow(spark.readStream.schema(part.schema).parquet(str(tmp_path / "part")), profiles, str(tmp_path / "c"), T.match_notices_from_part).awaitTermination()
    assert {r.program_id: (r.profiles, r.best) for r in feed.totals().collect()} == pair_totals(S.match_on_arrival(T.match_notices_from_part(part), profiles))
