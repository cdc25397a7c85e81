"""Repeated-substring removal by distributed prefix doubling on sparse positions.

Wanted: every byte covered by a LENGTH-byte string that starts somewhere else, too.  Ranking all
positions of a corpus means sorting a row per byte at every round; here positions are
sparse and leave as soon as they are unique:

* Positions.  A window of LENGTH bytes is represented by its anchor: the first START-byte block in it
  with the smallest rolling hash.  The choice depends on the window's bytes alone, so equal windows
  have equal anchors at equal offsets.  The windows of one anchor are a run of neighbouring
  starts, its context: about 1 anchor for 70 positions.
* First round.  An anchor's rank is its block (length START); ranks are grouped by Spark.  An
  anchor whose block is unique leaves: none of its windows repeats.  Equal pairs (rank, whole
  context) are repeats in all their windows and leave, too, but for one witness.
* Further rounds.  What is left is cut into cells of fewer window starts (CELLS) around the anchor.  All windows
  of a cell share a core, which grows towards LENGTH as cells shrink.  The pair (rank, core at its
  offset) is the next rank: a cell whose rank is unique leaves, a cell whose whole span occurs again
  is a repeat and leaves, the others go on, until a cell is one window and its core the LENGTH bytes.

Rank names are 64-bit hashes in place of sorted numbers (pairs of them from the first round
on), so a round is a partial aggregation and an equi-join, without a sort of a hot block's
positions in one task.  A block in a third of all rows is pre-aggregated before its shuffle.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import Scratch, prefix_hash, signed, span_hash, string_blocks, text_or_empty

LENGTH = 200
#: A document: its id (0 for a null one), whether that is null, and a hash of the text (rows may share an id).
DOC = ["k", "z", "th"]


def start_of(length: int) -> int:
    """Length of the first round's block: about a third of the window."""
    return max(1, length * 8 // 25)


def cells_of(length: int) -> list[int]:
    """Widths of the rounds' cells in window starts: each about a quarter of the one before, down to one."""
    width, out = length - start_of(length) + 1, []
    while width > 1:
        width = (width + 3) // 4
        out.append(width)
    return out


def anchors(offs: np.ndarray, data: np.ndarray, length: int):
    """(row, first window start, last window start, anchor, block hash, context hash) by row and place."""
    block = start_of(length)
    span = length - block + 1  # blocks in a window
    h = prefix_hash(data)
    out = []
    for row, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        n = b - a
        if n < length:
            continue
        at = np.arange(a, b - block + 1)
        g = span_hash(h, at, at + block)
        padded = np.full(-(-len(g) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        padded[:len(g)] = g
        grid = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(grid, 1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        windows = n - length + 1
        low = np.minimum(back[:windows], ahead[span - 1:span - 1 + windows])
        cut = np.concatenate([[True], low[1:] != low[:-1]])
        place = _first_of(g, low, span)
        cut[1:] |= place[1:] != place[:-1]
        first = np.flatnonzero(cut)
        last = np.append(first[1:], windows) - 1
        out.append((np.full(len(first), row), first, last, place[first], low[first], span_hash(h, a + first, a + last + length)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _first_of(g: np.ndarray, low: np.ndarray, span: int) -> np.ndarray:
    """For each window start i, the first j >= i with g[j] = low[i] (it exists within ``span``)."""
    # runs of equal window minima: within a run the minimum is one value, at one or several places
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    end = np.append(start[1:], len(low))
    places = np.empty(len(low), np.int64)
    # the last window of a run sees its minimum; places of that value inside the run's blocks
    order = np.argsort(g, kind="stable")
    value = g[order]
    lo = np.searchsorted(value, low[start], "left")
    hi = np.searchsorted(value, low[start], "right")
    single = hi - lo == 1
    places[:] = np.repeat(np.where(single, order[lo], -1), end - start)
    for k in np.flatnonzero(~single):
        spots = order[lo[k]:hi[k]]
        i = np.arange(start[k], end[k])
        places[i] = spots[np.searchsorted(spots, i)]
    return places


POSITIONS = "k long, z boolean, th long, first int, last int, anchor int, rank long, context long"


def positions(rows: DataFrame, length: int) -> DataFrame:
    """The anchors of (k, z, th, text)."""
    def run(batches):
        for batch in batches:
            for at, offs, data in string_blocks(batch.column("text")):
                row, first, last, anchor, rank, context = anchors(offs, data, length)
                of = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).take(of) for c in DOC), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                    pa.array(anchor.astype(np.int32)), pa.array(signed(rank)), pa.array(signed(context))],
                    names=[*DOC, "first", "last", "anchor", "rank", "context"])

    return rows.select(*DOC, "text").mapInArrow(run, POSITIONS)


def repeated_windows(rows: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(k, z, th, first, last): runs of window starts whose ``length`` bytes occur elsewhere; ``rows`` has (k, z, th, text)."""
    here = [*DOC, "anchor"]
    every = scratch.write(positions(rows, length), "anchors")
    # the repeated ranks are written first: a join of two plain exchanges is one whose large partitions Spark splits
    ranks = every.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("n > 1")
    ranks = scratch.write(ranks.select("rank", (F.col("lo") == F.col("hi")).alias("one")), "ranks")
    scratch.release_shuffles()
    live = scratch.write(every.join(ranks, "rank"), "live")
    scratch.drop(every, ranks)
    scratch.release_shuffles()
    found = [live.where("one").select(*DOC, "first", "last")]
    many = live.where("not one")
    classes = many.groupBy("rank", "context").agg(F.count(F.lit(1)).alias("n"),
                                                  F.min(F.struct(*DOC, "anchor", "first", "last")).alias("w"))
    classes = scratch.write(classes, "classes")
    again = classes.where("n > 1").select("rank", "context")
    found.append(many.join(again, ["rank", "context"], "left_semi").select(*DOC, "first", "last"))
    # bytes of one witness for each class: one look at the texts that hold witnesses
    wanted = (classes.select("rank", "n", "w.*").groupBy(*DOC).agg(F.collect_list(F.struct("rank", "n", "anchor", "first", "last")).alias("list")))
    texts = rows.join(wanted, DOC)
    body = F.col("text").cast("binary")
    texts = texts.select(*DOC, F.explode(F.transform("list", lambda x: x.withField("bytes", F.substring(body, x.first + 1, x.last - x.first + length)))).alias("x"))
    contexts = scratch.write(texts.select(*DOC, "x.*").dropDuplicates([*here, "rank"]), "contexts")
    scratch.release_shuffles()

    widest = length - start_of(length) + 1
    # offsets of window starts before the anchor: far >= near; the context's bytes begin at ``anchor - far``
    cells = contexts.select(*here, "rank", F.col("n").alias("weight"), (F.col("n") == 1).alias("open"),
                            (F.col("anchor") - F.col("last")).alias("near"), (F.col("anchor") - F.col("first")).alias("far"))
    held = contexts.select(*here, "rank", (F.col("anchor") - F.col("first")).alias("base"), "bytes")
    for width in cells_of(length):
        parts = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("near") / width).cast("int"), F.floor(F.col("far") / width).cast("int"))))
        parts = parts.withColumns({"near": F.greatest("near", F.col("cell") * width), "far": F.least("far", F.col("cell") * width + (width - 1))})
        top = F.least(F.col("cell") * width + (width - 1), F.lit(widest - 1))
        parts = parts.join(held, [*here, "rank"]).select(
            *here, "rank", "weight", "open", "cell", "near", "far",
            F.xxhash64(F.substring("bytes", F.col("base") - F.col("cell") * width + 1, F.lit(length) - (top - F.col("cell") * width))).alias("core"),
            F.xxhash64(F.substring("bytes", F.col("base") - F.col("far") + 1, F.lit(length) + F.col("far") - F.col("near"))).alias("span"))
        parts = scratch.write(parts, f"cells-{width}")
        key = ["rank", "cell", "core"]
        spans = parts.groupBy(*key, "near", "far", "span").agg(F.sum("weight").alias("n"), F.max("open").alias("some"))
        spans = scratch.write(spans, f"spans-{width}")
        found.append(parts.where("open").join(spans.where("n > 1 and some").select(*key, "near", "far", "span"), [*key, "near", "far", "span"], "left_semi")
                          .select(*DOC, (F.col("anchor") - F.col("far")).alias("first"), (F.col("anchor") - F.col("near")).alias("last")))
        if width == 1:
            break
        # go on where a rank has several spans, one of them met once only
        go = spans.groupBy(*key).agg(F.count(F.lit(1)).alias("spans"), F.min("n").alias("least")).where("spans > 1 and least = 1").select(*key)
        go = scratch.write(spans.select(*key, "near", "far", "span", "n").join(scratch.write(go, f"go-{width}"), key), f"on-{width}")
        alive = parts.join(go, [*key, "near", "far", "span"])
        fresh = alive.where("n = 1").select(*here, "rank", "weight", "open", "near", "far")
        seen = (alive.where("n > 1").groupBy(*key, "near", "far", "span")
                     .agg(F.min(F.struct(*here)).alias("w"), F.max("n").alias("weight"))
                     .select("w.*", "rank", "weight", F.lit(False).alias("open"), "near", "far"))
        cells = scratch.write(fresh.unionByName(seen), f"next-{width}")
        scratch.release_shuffles()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per input row: (id, n_bytes, spans [start, end) removed, kept bytes).

    Null counts as empty; texts shorter than ``length`` bytes stay whole.  Matches are made on UTF-8
    bytes and never cross documents, so what stays may begin or end inside a character (hence binary).
    Equal rows, also with one id, repeat each other and lose everything that is long enough.
    Null ids are ids like others.  An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    ident = docs[id_col].cast("long")
    rows = docs.select(F.coalesce(ident, F.lit(0)).alias("k"), ident.isNull().alias("z"), ident.alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    runs = repeated_windows(rows.drop("id"), scratch, length)
    runs = (runs.select(*DOC, F.struct(F.col("first").alias("a"), (F.col("last") + length).alias("b")).alias("r"))
                .groupBy(*DOC).agg(F.collect_list("r").alias("runs")))
    runs = scratch.write(runs, "runs")
    scratch.release_shuffles()
    keyed = rows.join(runs, DOC, "left")

    def run(batches):
        for batch in batches:
            ids, texts, lists = batch.column("id"), batch.column("text"), batch.column("runs")
            n, spans, counts, kept = [], [], [], []
            for i in range(batch.num_rows):
                data = np.frombuffer(texts[i].as_buffer(), np.uint8)
                n.append(len(data))
                got = lists[i].values if lists[i].is_valid else None
                if got is None or not len(got):
                    counts.append(0)
                    kept.append(data.tobytes())
                    continue
                a, b = got.field("a").to_numpy(), got.field("b").to_numpy()
                delta = np.zeros(len(data) + 1, np.int64)
                np.add.at(delta, a, 1)
                np.add.at(delta, b, -1)
                gone = np.cumsum(delta[:-1]) > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans.append(np.stack([starts, ends], 1))
                counts.append(len(starts))
                kept.append(data[~gone].tobytes())
            flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int64)), pa.array(flat[:, 1].astype(np.int64))], names=["start", "end"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pairs), pa.array(kept, pa.binary())],
                                             names=["id", "n_bytes", "spans", "kept"])

    return keyed.select("id", "text", "runs").mapInArrow(run, "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
