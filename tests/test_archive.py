"""The raw archive: marks, replays, crashes, readers that see new partitions only."""
import datetime as dt
import random

import pytest

from tidewater.operators.archive import RawArchive, backfill_newer
from tidewater.scratch import Scratch

COLS = "source_id string, source_doc_id string, content_hash string, payload string, published_at string, fetched_at timestamp, seq long"


def rows(spark, items):
    """items: (source, doc, payload, published, seq)"""
    return spark.createDataFrame([(s, d, f"h{p}", p, pub, dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), n) for s, d, p, pub, n in items], COLS)


@pytest.fixture
def archive(spark):
    return RawArchive(spark, Scratch(spark, "test").folder("raw"), rows(spark, [("a", "1", "p", "2024-01-01", 1)]).schema)


def test_marks_move_with_the_rows(spark, archive):
    archive.append(0, rows(spark, [("a", "1", "p", "2024-01-05 10:00:00", 1), ("a", "1", "p", "2024-01-09", 2), ("b", "1", "q", "soon", 3), (None, "1", "q", "2024-01-30", 4), ("a", None, "q", "2024-01-30", 5)]))
    archive.append(1, rows(spark, [("a", "2", "r", "2024-01-03", 6), ("a", "1", "p", "2024-02-02", 7)]))
    got = {r.source_id: (r.n_rows, r.max_published, r.since) for r in archive.since(dt.date(2024, 3, 1)).collect()}
    # the first of equal documents is kept; an older date moves no mark back; no valid date, no mark
    assert got == {"a": (2, dt.date(2024, 1, 5), dt.date(2023, 12, 29)), "b": (1, None, dt.date(2024, 1, 31))}
    archive.append(1, rows(spark, [("a", "9", "z", "2025-01-01", 8)]))   # replayed: left as it is
    assert archive.read().count() == 3


def test_a_crash_before_the_swap_leaves_rows_and_marks(spark, archive, monkeypatch):
    archive.append(0, rows(spark, [("a", "1", "p", "2024-01-05", 1)]))
    more = rows(spark, [("a", "2", "q", "2024-01-08", 2), ("c", "1", "q", "2024-01-08", 3)])
    with monkeypatch.context() as m:
        m.setattr(archive, "_publish", lambda _: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            archive.append(1, more)
    assert archive.read().count() == 1 and set(archive.manifest()["sources"]) == {"a"}
    archive.append(1, more)
    assert archive.read().count() == 3 and archive.manifest()["sources"]["a"]["high"] == "2024-01-08"


def test_readers_scan_new_partitions_only(spark, archive):
    archive.append(0, rows(spark, [("a", "1", "p", "2024-01-05", 1), ("b", "1", "p", "2024-01-05", 2)]))
    first, marks = archive.pending("r")
    assert first.count() == 2
    again, _ = archive.pending("r")           # not acknowledged: read again
    assert again.count() == 2
    archive.acknowledge("r", marks)
    archive.append(1, rows(spark, [("a", "2", "p", "2024-01-06", 3)]))
    archive.append(2, rows(spark, [("b", "2", "p", "2024-01-07", 4), ("a", "3", "p", "2024-01-07", 5)]))
    new, marks = archive.pending("r")
    assert marks == {"a": 2, "b": 2} and sorted((r.source_id, r.source_doc_id, r.batch) for r in new.collect()) == [("a", "2", 1), ("a", "3", 2), ("b", "2", 2)]
    files = new.inputFiles()
    assert len(files) >= 2 and not any("/batch=0/" in f for f in files)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "batch" in plan.split("PartitionFilters: [")[1].split("]")[0]
    archive.acknowledge("r", marks)
    assert archive.pending("r")[0].count() == 0 and archive.pending("other")[0].count() == 5


def test_backfill_by_batches_equals_one_pass(spark, archive):
    rng = random.Random(5)
    items = [(rng.choice("ab"), str(rng.randint(1, 6)), rng.choice(["", " ", "x", "y", "z", "w"]), "2024-01-01", n) for n in range(80)]
    keys = ["source_id", "source_doc_id"]
    state = spark.createDataFrame([(s, str(d), None, None, None) for s in "ab" for d in range(1, 8)], "source_id string, source_doc_id string, payload string, payload_ts timestamp, payload_seq long")
    for n, part in enumerate([items[40:], items[:40]]):     # the older half arrives last
        archive.append(n, rows(spark, part))
        new, marks = archive.pending("state")
        for _ in range(2):                                  # and every batch is read twice
            state = backfill_newer(state, new, keys, "payload", "fetched_at", "seq").drop("backfilled")
        archive.acknowledge("state", marks)
    want = {}
    kept = set()
    for part in (items[40:], items[:40]):
        for s, d, p, _, n in part:
            if (s, d, p) in kept:
                continue
            kept.add((s, d, p))
            if p.strip() and n >= want.get((s, d), (-1, None))[0]:
                want[(s, d)] = (n, p)
    got = {(r.source_id, r.source_doc_id): (r.payload_seq, r.payload) for r in state.collect() if r.payload is not None}
    assert got == want and state.count() == 14
