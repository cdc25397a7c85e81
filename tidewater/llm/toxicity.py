"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Features are letter words and their beginnings of PREFIXES bytes (inflected forms share them).  A bounded sample of labelled rows
(MAX_EXAMPLES of each label) gives the examples and the vocabulary (features whose
presence differs between the labels beyond chance); inverse document frequencies are counted over all
documents.  The examples form a block-max inverted index: postings by (feature, block of
BLOCK examples) and the largest weight of each feature in each block.  A document's bound for a
block is the sum of these; blocks whose bound is below the K-th best cosine are never
opened, so the K neighbours are exact.  Cosine-weighted votes, calibrated on the
examples themselves (each left out of its own vote), give the score; the neighbours are the evidence.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import lower_ascii, prefix_hash, span_hash, string_blocks, text_or_empty

#: Labelled documents of each label in the index, the smallest hashes of doc_id first.
MAX_EXAMPLES = 2000
#: Vocabulary: features at least MIN_ODDS times as frequent in one label as in the other, with a G statistic of MIN_G (far
#: beyond chance among all features of the sample); the strongest MAX_FEATURES.
MIN_ODDS, MIN_G, MAX_FEATURES = 8.0, 24.0, 8192
PREFIXES = (4, 5, 6)
BLOCK, K = 64, 15
FOLDS, HELD_OUT = 3, 1
TOXIC_AT = 0.7
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def features(offs: np.ndarray, data: np.ndarray):
    """(row, feature hash, count) of the distinct features of each text, by row and hash."""
    data = lower_ascii(data)
    ok = _LETTER[data]
    first, last = ok.copy(), ok.copy()
    first[1:] &= ~ok[:-1]
    last[:-1] &= ~ok[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = ok[inner]
    last[inner - 1] = ok[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offs, starts, "right") - 1
    h = prefix_hash(data)
    rows, values = [row], [span_hash(h, starts, ends) if len(starts) else np.zeros(0, np.uint64)]
    for n in PREFIXES:
        long = ends - starts > n
        if long.any():
            rows.append(row[long])
            values.append(span_hash(h, starts[long], starts[long] + n) ^ np.uint64(0x5851F42D4C957F2D))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return rows[at], values[at], np.diff(np.append(at, len(rows)))


class Index:
    """Examples as postings by feature and block, with block maxima."""

    def __init__(self, vocabulary, idf, ids, labels, rows, feats, weights):
        self.vocabulary, self.idf, self.ids, self.labels = vocabulary, idf, ids, labels
        n, m = len(ids), len(vocabulary) + 1
        self.blocks = max(1, -(-n // BLOCK))
        order = np.lexsort((rows, feats))
        self.doc, self.weight = rows[order], weights[order].astype(np.float64)
        cell = feats[order] * self.blocks + rows[order] // BLOCK
        self.at = np.searchsorted(cell, np.arange(m * self.blocks + 1))
        self.top = np.zeros((m, self.blocks))
        np.maximum.at(self.top.reshape(-1), cell, self.weight)
        self.curve = None
        self.empty = 0.0

    def vector(self, values, counts):
        """Unit TF-IDF vector over the vocabulary and one coordinate for the rest: (features, weights)."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0)
        k = np.minimum(np.searchsorted(self.vocabulary, values), len(self.vocabulary) - 1)
        hit = self.vocabulary[k] == values
        k = k[hit]
        w = (1 + np.log(counts[hit])) * self.idf[k]
        if len(values):  # the last coordinate stands for all the other words: one stray word in a long text is no insult
            k, w = np.append(k, len(self.vocabulary)), np.append(w, np.log1p(counts[~hit].sum()))
        return k, w / max(float(np.sqrt((w * w).sum())), 1e-12)

    def _open(self, blocks, k, w, best):
        cells = (k[:, None] * self.blocks + blocks[None]).ravel()
        start, n = self.at[cells], self.at[cells + 1] - self.at[cells]
        total = int(n.sum())
        if not total:
            return
        p = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(total)
        best += np.bincount(self.doc[p], np.repeat(np.repeat(w, len(blocks)), n) * self.weight[p], minlength=len(best))

    def nearest(self, k, w, skip: int = -1):
        """The K examples of largest cosine (ties: smaller place first): places and cosines, exact."""
        bound = w @ self.top[k]
        order = np.argsort(-bound, kind="stable")
        sims = np.zeros(len(self.ids))
        done, step = 0, 4
        while done < len(order):
            part = order[done:done + step]
            part = part[bound[part] > 0]
            if not len(part):
                break
            self._open(part, k, w, sims)
            if skip >= 0:
                sims[skip] = 0
            done += step
            step *= 2
            if len(sims) > K and done < len(order):
                floor = np.partition(sims, len(sims) - K)[len(sims) - K]
                if floor > 0 and bound[order[done]] < floor - 1e-12:
                    break
        top = np.argpartition(-sims, min(K, len(sims) - 1))[:K] if len(sims) > K else np.arange(len(sims))
        cut = sims[top].min() if len(top) else 0
        top = np.flatnonzero(sims >= max(cut, 1e-12))
        top = top[np.lexsort((top, -sims[top]))][:K]
        return top, sims[top]

    def vote(self, k, w, skip: int = -1):
        """(share of the cosine-weighted votes for label 1, evidence); None without a neighbour."""
        if not len(k) or not len(self.ids):
            return None, np.zeros(0, int), np.zeros(0)
        top, s = self.nearest(k, w, skip)
        if not len(top):
            return None, top, s
        weight = s * s
        return float((weight * self.labels[top]).sum() / weight.sum()), top, s

    def calibrate(self, queries, base_rate: float):
        """Score of a vote: a logistic curve fitted on left-out votes, classes weighted back to
        ``base_rate``; texts without a neighbour get the rate of such examples."""
        votes = [self.vote(k, w, i)[0] for i, (k, w) in enumerate(queries)]
        y = self.labels
        ones, zeros = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
        weight = np.where(y == 1, base_rate / ones, (1 - base_rate) / zeros) * len(y)
        none = np.array([v is None for v in votes], bool)
        self.empty = float(((weight * y)[none].sum() + base_rate) / (weight[none].sum() + 1.0))
        x = np.array([v for v in votes if v is not None])
        t, g = y[~none].astype(float), weight[~none]
        a, b = 4.0, -2.0
        for _ in range(50):  # Newton steps with a slight ridge
            if not len(x):
                break
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            r, v = g * (p - t), g * p * (1 - p) + 1e-9
            grad = np.array([(r * x).sum() + 0.01 * a, r.sum() + 0.01 * b])
            hess = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
            da, db = np.linalg.solve(hess, grad)
            a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        self.curve = (float(a), float(b))

    def score(self, values, counts):
        k, w = self.vector(values, counts)
        v, top, s = self.vote(k, w)
        if v is None:
            return self.empty, top, s
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * v + b, -30, 30)))), top, s


def select_features(values: np.ndarray, label: np.ndarray, n0: int, n1: int):
    """Features (one value a document and feature) whose presence depends on the label: G-test."""
    v, inv = np.unique(values, return_inverse=True)
    b = np.bincount(inv, label, minlength=len(v))
    a = np.bincount(inv, minlength=len(v)) - b
    total = a + b

    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    n = n0 + n1
    g = 2 * (part(a, total * n0 / n) + part(b, total * n1 / n) + part(n0 - a, (n - total) * n0 / n) + part(n1 - b, (n - total) * n1 / n))
    odds = ((b + 0.5) / (n1 + 1)) / ((a + 0.5) / (n0 + 1))
    ok = np.flatnonzero((np.maximum(odds, 1 / odds) >= MIN_ODDS) & (g >= MIN_G))
    ok = ok[np.lexsort((v[ok], -g[ok]))][:MAX_FEATURES]
    return np.sort(v[ok])


def build(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> Index | None:
    """The index from ``labels`` (doc_id, toxic: training rows only) over ``docs`` (all rows count for idf).

    None if no labelled document is found, or only of one label.
    """
    lab = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    size = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return None
    picked = [lab.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_examples) for y in (0, 1)]
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sample = rows.join(F.broadcast(picked[0].union(picked[1])), "id")

    def example(batches):
        for batch in batches:
            for row, offs, data in string_blocks(batch.column("text")):
                r, v, c = features(offs, data)
                cut = np.searchsorted(r, np.arange(1, len(offs) - 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(row, len(offs) - 1), batch.column("y").slice(row, len(offs) - 1),
                    pa.array([x.tobytes() for x in np.split(v, cut)], pa.binary()), pa.array([x.astype(np.int32).tobytes() for x in np.split(c, cut)], pa.binary())],
                    names=["id", "y", "v", "c"])

    got = sample.mapInArrow(example, "id long, y int, v binary, c binary").toArrow()
    got = sorted(zip(got["id"].to_pylist(), got["y"].to_pylist(), got["v"].to_pylist(), got["c"].to_pylist()))
    y = np.array([g[1] for g in got])
    if len(set(y.tolist())) < 2:
        return None
    vs = [np.frombuffer(g[2], np.uint64) for g in got]
    cs = [np.frombuffer(g[3], np.int32) for g in got]
    n = np.array([len(v) for v in vs])
    vocabulary = select_features(np.concatenate(vs), np.repeat(y, n), int((y == 0).sum()), int((y == 1).sum()))

    def frequencies(batches):
        df, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for _, offs, data in string_blocks(batch.column("text")):
                _, v, _ = features(offs, data)
                if len(vocabulary):
                    k = np.minimum(np.searchsorted(vocabulary, v), len(vocabulary) - 1)
                    df += np.bincount(k[vocabulary[k] == v], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary)), pa.int32()), pa.array(np.append(total, df), pa.int64())], names=["feature", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # MAX_FEATURES + 1 rows at most
    df = np.zeros(len(vocabulary) + 1)
    df[counted["feature"].to_numpy() + 1] = counted["n"].to_numpy()
    idf = np.log((1 + df[0]) / (1 + df[1:]))
    index = Index(vocabulary, idf, np.array([g[0] for g in got]), y, *(np.zeros(0, np.int64),) * 2, np.zeros(0))
    vectors = [index.vector(v, c) for v, c in zip(vs, cs)]
    index = Index(vocabulary, idf, index.ids, y, np.repeat(np.arange(len(got)), [len(k) for k, _ in vectors]),
                  np.concatenate([k for k, _ in vectors]), np.concatenate([w for _, w in vectors]))
    index.calibrate(vectors, size[1] / (size[0] + size[1]))
    return index


def score(docs: DataFrame, index: Index | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, score and evidence (nearest examples: doc_id, cosine, label; nearest first).

    Null counts as empty; a text without a word gets the base rate and no evidence; without an index the score is 0.  Equal texts get equal scores.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), text_or_empty(text_col).alias("text"))
    kind = "score double, evidence array<struct<doc_id: bigint, cosine: double, label: int>>"
    entry = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        for batch in batches:
            for at, offs, data in string_blocks(batch.column("text")):
                n = len(offs) - 1
                scores, evidence = np.zeros(n), [[]] * n
                if index is not None:
                    r, v, c = features(offs, data)
                    cut = np.searchsorted(r, np.arange(n + 1))
                    for i in range(n):
                        scores[i], top, s = index.score(v[cut[i]:cut[i + 1]], c[cut[i]:cut[i + 1]])
                        evidence[i] = [{"doc_id": int(index.ids[j]), "cosine": float(x), "label": int(index.labels[j])} for j, x in zip(top[:3], s)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, n), pa.array(scores), pa.array(evidence, entry)], names=["row", "score", "evidence"])

    schema = StructType([rows.schema["row"], *_parse_datatype_string(kind).fields])
    return rows.mapInArrow(run, schema).select("row.*", "score", "evidence")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", fold.alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fold)
    out = score(docs, build(docs, labels), ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))
