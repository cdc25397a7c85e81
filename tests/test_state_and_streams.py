"""Merge semantics, streams against batches, guarded export, scratch folder."""
import csv
import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from tidewater.functions.korean import CATALOGUE_TEXT
from tidewater.jobs import ingest_jobs as J
from tidewater.operators import ingest as I
from tidewater.operators import workflow as W
from tidewater.scratch import Scratch, shared_dir
from tidewater.sources import feeds
from tidewater.streaming import streams as S

STATE = "k string, period_end date, content_hash string, created_at timestamp, last_seen_at timestamp, synced_at timestamp, is_open boolean"
BATCH = "k string, period_end date, content_hash string, seq int"
T0, NOW, DAY = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), dt.date(2024, 1, 15)


def test_merge_replays_the_batch(spark):
    later = dt.date(2024, 6, 1)
    state = spark.createDataFrame([(k, later, "A", T0, T0, T0, o) for k, o in (("aba", True), ("closed", False), ("same", False), ("new-end", True))], STATE)
    batch = spark.createDataFrame([("aba", later, "B", 1), ("aba", later, "A", 2), ("same", later, "A", 1), ("new-end", dt.date(2024, 1, 2), "C", 1), ("fresh", None, "A", 1), (None, later, "Z", 1)], BATCH)
    got = {r.k: r for r in I.upsert(state, batch, ["k"], ["period_end"], NOW, DAY, ["seq"]).collect()}
    assert got["aba"].outcome == "updated" and got["aba"].synced_at == NOW and got["aba"].content_hash == "A"
    assert got["closed"].outcome == "untouched" and got["closed"].is_open is False and got["closed"].last_seen_at == T0
    assert got["same"].outcome == "unchanged" and got["same"].is_open is False and got["same"].last_seen_at == NOW and got["same"].synced_at == T0
    assert got["new-end"].outcome == "updated" and got["new-end"].is_open is False
    assert got["fresh"].outcome == "inserted" and got["fresh"].is_open is True and None not in got
    b = batch.where("k is not null").withColumn("at", F.lit(T0))
    counts = {r.k: (r.fetched, r.upserted) for r in I.replay_counts(state, b, ["k"], ["at", "seq"]).collect()}
    assert counts == {"aba": (2, 2), "same": (1, 0), "new-end": (1, 1), "fresh": (1, 1)}


def test_hash_tells_null_from_blank(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a|", ""), (None, "a")], "x string, y string")
    assert df.select(I.content_hash("x", "y").alias("h")).distinct().count() == 4


def test_stream_upsert_in_batches_equals_one_merge(spark, tmp_path):
    good, _ = J.normalized_feed(spark, "/root/testdata/sf0.001")
    good.withColumn("part", F.when(F.col("fetched_at") < "2024-01-10", 0).otherwise(1)).createOrReplaceTempView("good")
    src = str(tmp_path / "src")
    for i in (0, 1):
        spark.sql(f"select * from good where part = {i}").drop("part").coalesce(1).write.mode("append").parquet(src)
    root = "file://" + str(tmp_path / "state")
    raw = spark.readStream.schema(good.schema).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):  # the second run finds nothing new and changes nothing
        S.continuous_upsert(raw, root, J.KEYS, J.FIELDS, J.ORDER, J.RUN_TS, J.FEED_AS_OF, str(tmp_path / "ck")).awaitTermination()
    out = S.upsert_state(good, root, J.KEYS, J.FIELDS).read()
    one = I.upsert(S._empty_state(good, J.KEYS, J.FIELDS), good, J.KEYS, J.FIELDS, J.RUN_TS, J.FEED_AS_OF, J.ORDER)
    cols = [*J.KEYS, *J.FIELDS, "content_hash", "is_open"]
    assert out.count() == one.count() and out.select(cols).exceptAll(one.select(cols)).isEmpty()


def test_export_is_guarded_and_newest_first(spark, tmp_path):
    df = spark.createDataFrame([(9, "=1+1", ["a", "b"]), (10, 'say "x"', None), (2, "-5", [])], "id int, note string, tags array<string>")
    feeds.export_csv(df.coalesce(1), str(tmp_path / "out"), ["tags"], "id")
    rows = [r for f in sorted(glob.glob(str(tmp_path / "out/part-*"))) for r in list(csv.reader(open(f)))[1:]]
    assert rows == [["10", 'say "x"', ""], ["9", "'=1+1", "a | b"], ["2", "'-5", ""]]


def test_envelopes(spark):
    rows = [('{"response":{"body":{"items":{"item":[{"id":1},{"id":" 2 "}]}}}}',), ('[{"id":3}]',), ('{"items":{"item":[{"pbancSn":"4"}]}}',), ("not json",), ('{"data":{}}',), (None,)]
    got = feeds.fields_of(feeds.read_landed(spark.createDataFrame(rows, "payload string"), "payload", feeds.STARTUP_PATHS), {"doc": feeds.STARTUP_FIELDS["doc"]})
    assert sorted(r.f_doc for r in got.collect()) == ["1", "2", "3", "4"]


def test_patches_of_one_id_act_in_order(spark):
    state = spark.createDataFrame([(1, "pending", "m")], "id int, status string, memo string")
    p = spark.createDataFrame([(1, 1, "contacted", "first"), (1, 2, None, "second"), (1, 3, "gone", "third"), (2, 1, "pending", None)], "id int, seq int, status string, memo string")
    out, bad = W.apply_patches(state, p)
    assert [tuple(r) for r in out.collect()] == [(1, "contacted", "second")] and [r.seq for r in bad.collect()] == [3]


def test_scratch_tables_can_be_dropped(spark):
    s = Scratch(spark, "test")
    t = s.write(spark.range(5), "t")
    assert t.count() == 5 and s.base.startswith(shared_dir(spark))
    s.close()
    with pytest.raises(Exception):
        spark.read.parquet(t._scratch_path).count()


def test_nothing_is_cut_by_default(spark):
    """A body of 3,000 characters and two ids that differ after 60 stay whole; bounds cut only where they are passed."""
    ids = ["n" * 60 + x for x in "ab"]
    rows = [(json.dumps({"data": [{"id": i, "pbancSn": i, "biz_pbanc_nm": "title " * 60, "pbanc_ctnt": "b" * 3000}]}),) for i in ids]
    fields = feeds.read_landed(spark.createDataFrame(rows, "payload string"), "payload", feeds.STARTUP_PATHS)
    whole, bounded = feeds.normalize_startup(fields).collect(), feeds.normalize_startup(fields, CATALOGUE_TEXT).collect()
    assert sorted(r.program_id for r in whole) == [f"KS-{i}" for i in ids] and {len(r.summary) for r in whole} == {3000}
    assert {len(r.summary) for r in bounded} == {500} and all(len(r.name) > 200 for r in whole)
    memo = spark.createDataFrame([(1, 1, "pending", "m" * 6000)], "id int, seq int, status string, memo string")
    out, _ = W.apply_patches(spark.createDataFrame([(1, "pending", "")], "id int, status string, memo string"), memo)
    assert len(out.first().memo) == 6000


def test_ledger_over_runs_carries_the_state(spark):
    day = dt.datetime(2024, 1, 1)
    good = spark.createDataFrame([("r1", "a", day, 1, "A"), ("r1", "a", day, 2, "B"), ("r2", "a", day, 3, "B"), ("r2", "b", day, 4, "X"), ("r4", "a", day, 5, "A"),
                                  ("r6", "b", day, 6, "X")], "run_id string, k string, at timestamp, seq int, content_hash string")
    bad = spark.createDataFrame([("r2", 7, "error", "second"), ("r2", 5, "error", "first"), ("r3", 8, "error", "only"), ("r4", 9, "invalid", None), ("r5", 9, "invalid", None),
                                 ("r6", 9, "error", "late"), ("r7", 9, "invalid", None)], "run_id string, seq int, reject string, error string")
    got = [tuple(r) for r in I.run_ledger(good, bad, ["k"], ["at", "seq"]).orderBy("run_id").collect()]
    assert got == [("r1", 2, 2, 0, 0, None, "success"), ("r2", 4, 1, 1, 2, "first", "partial"), ("r3", 1, 0, 0, 1, "only", "failed"), ("r4", 2, 1, 1, 0, None, "success"),
                   ("r5", 1, 0, 1, 0, None, "success"), ("r6", 2, 0, 1, 1, "late", "failed"), ("r7", 1, 0, 1, 0, None, "success")]


def test_profiles_and_their_satellites(spark):
    """The last form of a user replaces the whole row of both tables; others and their times stay."""
    import datetime as dt
    now, old = dt.datetime(2024, 3, 1), dt.datetime(2023, 1, 1)
    cols = "biz_name string, founded_year string, industry_code string, region_sido string, region_sigungu string, {}, revenue_band string, segments array<string>"
    state = spark.createDataFrame([(1, "a", "2020", "x", "s", "g", 5, "r", ["A"], old), (2, "b", None, None, None, "h", None, None, ["B"], old)],
                                  "user_id int, " + cols.format("employee_cnt int") + ", updated_at timestamp")
    forms = spark.createDataFrame(
        [(1, "first", "2021", "y", "s", "g", "12", "r", ["C"], 1, "sum", "d", "t", "e"), (1, "last", "", "y", "s", "", "0", "", None, 2, "new", "", None, "e"),
         (3, "c", "2022", "z", "", "i", "7 people", "big", ["D"] * 12, 3, "", "d", "", "")],
        "user_id int, " + cols.format("employees string") + ", seq int, biz_summary string, product_desc string, core_tech string, competitive_edge string")
    got = {r.user_id: tuple(r) for r in W.merge_profiles(state, forms, now, 9).collect()}
    assert got[1] == (1, "last", None, "y", "s", None, None, None, [], now, True)
    assert got[2] == (2, "b", None, None, None, "h", None, None, ["B"], old, False)
    assert got[3] == (3, "c", "2022", "z", None, "i", 7, "big", ["D"] * 9, now, True)
    held = spark.createDataFrame([(10, "s", "p", "t", "e"), (20, "s2", None, None, None)], "profile_id int, biz_summary string, product_desc string, core_tech string, competitive_edge string")
    ids = spark.createDataFrame([(1, 10), (2, 20)], "user_id int, profile_id int")
    assert sorted(tuple(r) for r in W.merge_satellite(held, ids, forms).collect()) == [(10, "new", None, None, "e"), (20, "s2", None, None, None)]


def test_patch_times(spark):
    import datetime as dt
    now, old = dt.datetime(2024, 3, 1), dt.datetime(2023, 1, 1)
    state = spark.createDataFrame([(i, "pending", "m", old) for i in (1, 2, 3, 4)], "id int, status string, memo string, updated_at timestamp")
    p = spark.createDataFrame([(1, 1, "pending", None), (2, 1, None, None), (3, 1, "lost", "x")], "id int, seq int, status string, memo string")
    out, _ = W.apply_patches(state, p, now)
    assert {r.id: r.updated_at for r in out.collect()} == {1: now, 2: old, 3: old, 4: old}
